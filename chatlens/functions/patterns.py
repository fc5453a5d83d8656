"""Regular expressions shared by the operators.

All patterns are written so that Java (Spark) and RE2 (the DuckDB oracle) read them the same way:
no look-around, no bare ``\\w`` (Java's is ASCII-only, the reference's is Unicode), explicit
code-point classes instead of ``\\s``.
"""

from __future__ import annotations

# ---- FIXED VALUES (must equal the reference's behaviour) -------------------------------------
# Word character as the reference's regex engine defines it: letters, digits, underscore.
WORD = r"[\p{L}\p{N}_]"
# Hashtags and mentions: '#' or '@' followed by word characters.
HASHTAG = r"#[\p{L}\p{N}_]+"
MENTION = r"@[\p{L}\p{N}_]+"
# Fixed value: the characters a URL runs over, '!', the range '$'..'_' and a-z. One class, as alternatives inside a
# repetition recurse in Java's engine and overflow its stack on long URLs.
URL = r"http[s]?://[!$-_a-z]+"
# Network location of a URL: text after '//' up to the first '/', '?' or '#'.
URL_NETLOC = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"
# File extension: the text after the last dot, if it contains no dot.
EXTENSION = r"\.([^.]+)$"
# File name characters that count as "special": anything but word characters, whitespace
# (the reference's Unicode whitespace set, spelled out), '.' and '-'.
SPECIAL_CHAR = (r"[^\p{L}\p{N}_\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
                r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}.\-]")
# Emoji sequences by Unicode's property Emoji and the grammar of its emoji report: pairs of regional indicators (flags); keycaps; an emoji
# with a variation selector or skin tone, or with tags up to the cancel tag (subdivision flags); such elements joined by zero-width joiners.
# The property's ranges without digits, '#', '*' and regional indicators, in hex.
EMOJI_RANGES = """a9 ae 203c 2049 2122 2139 2194-2199 21a9-21aa 231a-231b 2328 23cf 23e9-23f3 23f8-23fa 24c2 25aa-25ab 25b6 25c0 25fb-25fe 2600-2604
260e 2611 2614-2615 2618 261d 2620 2622-2623 2626 262a 262e-262f 2638-263a 2640 2642 2648-2653 265f-2660 2663 2665-2666 2668 267b 267e-267f 2692-2697
2699 269b-269c 26a0-26a1 26a7 26aa-26ab 26b0-26b1 26bd-26be 26c4-26c5 26c8 26ce-26cf 26d1 26d3-26d4 26e9-26ea 26f0-26f5 26f7-26fa 26fd 2702 2705
2708-270d 270f 2712 2714 2716 271d 2721 2728 2733-2734 2744 2747 274c 274e 2753-2755 2757 2763-2764 2795-2797 27a1 27b0 27bf 2934-2935 2b05-2b07
2b1b-2b1c 2b50 2b55 3030 303d 3297 3299 1f004 1f0cf 1f170-1f171 1f17e-1f17f 1f18e 1f191-1f19a 1f201-1f202 1f21a 1f22f 1f232-1f23a 1f250-1f251
1f300-1f321 1f324-1f393 1f396-1f397 1f399-1f39b 1f39e-1f3f0 1f3f3-1f3f5 1f3f7-1f4fd 1f4ff-1f53d 1f549-1f54e 1f550-1f567 1f56f-1f570 1f573-1f57a
1f587 1f58a-1f58d 1f590 1f595-1f596 1f5a4-1f5a5 1f5a8 1f5b1-1f5b2 1f5bc 1f5c2-1f5c4 1f5d1-1f5d3 1f5dc-1f5de 1f5e1 1f5e3 1f5e8 1f5ef 1f5f3
1f5fa-1f64f 1f680-1f6c5 1f6cb-1f6d2 1f6d5-1f6d9 1f6dc-1f6e5 1f6e9 1f6eb-1f6ec 1f6f0 1f6f3-1f6fc 1f7e0-1f7eb 1f7f0 1f90c-1f93a 1f93c-1f945
1f947-1f9ff 1fa70-1fa7c 1fa80-1fac6 1fac8 1facc-1fadd 1fadf-1faeb 1faef-1fafa"""
_EMOJI_BASE = "[" + "".join("-".join(rf"\x{{{x}}}" for x in r.split("-")) for r in EMOJI_RANGES.split()) + "]"
_EMOJI_ELEMENT = _EMOJI_BASE + r"(?:[\x{E0020}-\x{E007E}]+\x{E007F}|[\x{FE0F}\x{1F3FB}-\x{1F3FF}])?"
EMOJI = r"[\x{1F1E6}-\x{1F1FF}]{2}|[0-9#*]\x{FE0F}?\x{20E3}|" + _EMOJI_ELEMENT + r"(?:\x{200D}" + _EMOJI_ELEMENT + r")*"
# ASCII characters that can never be part of an emoji sequence (all but digits, '#', '*').
# Collapsing runs of them to one space leaves every emoji match unchanged (a space never
# matches, so no match can span a collapsed run) and shrinks mostly-ASCII text to a few chars.
EMOJI_FREE_ASCII_RUN = r"[\x00-\x22\x24-\x29\x2B-\x2F\x3A-\x7F]+"
# Channel collection file names: tg_<channel>_<min id>_<max id>.json, channel may hold '_'.
COLLECTION_FILE = r"^tg_(.+)_(\d+)_(\d+)\.json$"
COMBINED_FILE = r"^tg_(.+)_combined\.json$"
# Values the reference treats as missing when they arrive as strings.
NULL_STRINGS = ("NaN", "NaT", "nan", "nat")
# ------------------------------------------------------------------------------------------------


def sql_literal(pattern: str) -> str:
    """Quote a pattern as a DuckDB string literal (no backslash escapes in DuckDB strings)."""
    return "'" + pattern.replace("'", "''") + "'"
