"""Text that was decoded with the wrong encoding."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Encodings that UTF-8 bytes are read with by mistake.
CODECS = ("cp1252", "cp1250", "mac_roman", "cp437", "cp932", "cp1251", "cp1254", "cp850")
LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"
LOWER = "a-zß-öø-ÿ"
CYRILLIC = "Ѐ-џ"

#: Well-formed multibyte sequences of UTF-8, one byte a character.
SEQUENCE = (
    "[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]"
    "|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2}"
)
SPAN = re.compile(f"(?:{SEQUENCE})+")
#: What a decoded span may consist of: Latin letters and signs, common punctuation, mathematics, Greek, Cyrillic.
PLAUSIBLE = re.compile("[\xa0-ſȘ-țƒˆ˜΄-ώЀ-џ‐-‧‰-›€™←-⇿∀-⋿─-╿ﬁﬂ]+")
#: Control characters, which stand for a byte of a text garbled more than once.
C1 = re.compile("[\x80-\x9f]")
#: Decoded letters that count only as words of two or more.
OTHER_SCRIPT = re.compile("[΄-ώЀ-џ]")


def high_half(codec: str) -> list[str]:
    """The characters of bytes 128 to 255; a byte without one stands for itself."""
    chars = []
    for b in range(128, 256):
        try:
            c = bytes([b]).decode(codec)
        except UnicodeDecodeError:
            c = chr(b)
        chars.append(c if len(c) == 1 else chr(b))
    return chars


def misread(text: str, codec: str, right: str = "utf-8") -> str:
    """``text`` in the encoding ``right``, decoded as ``codec`` by mistake."""
    chars = high_half(codec)
    return "".join(chr(b) if b < 128 else chars[b - 128] for b in text.encode(right))


class _ToBytes(dict):
    """A translation of characters to the byte they came from; all others outside ASCII become U+FFFF."""

    def __missing__(self, code: int) -> int:
        self[code] = code if code < 128 else 0xFFFF
        return self[code]


def _char_class(chars: list[str]) -> str:
    return "[" + "".join(re.escape(c) for c in chars) + "]"


@lru_cache(maxsize=None)
def to_bytes(codec: str) -> _ToBytes:
    table = _ToBytes()
    for b in range(128, 256):  # a stray byte that was kept as it is
        table[b] = b
    for b, c in enumerate(high_half(codec), 128):
        table[ord(c)] = b
    return table


def lead_pair(codec: str) -> tuple[list[str], list[str]]:
    """The characters that a span of this codec begins with, and those that continue it."""
    chars = high_half(codec)
    strays = [chr(b) for b in range(128, 256)]
    free = [c for c in strays if c not in chars]  # strays that no byte of the codec shows as
    take = lambda low, high: chars[low - 128 : high - 128] + [c for c in strays[low - 128 : high - 128] if c in free]
    return take(0xC2, 0xF5), take(0x80, 0xC0)


@lru_cache(maxsize=None)
def pair_pattern(codec: str) -> re.Pattern:
    lead, cont = lead_pair(codec)
    return re.compile(_char_class(lead) + _char_class(cont))


@lru_cache(maxsize=None)
def shown_by_codecs() -> re.Pattern:
    """Characters that a text garbled more than once shows between two rounds: those of the high halves of the encodings for Latin text."""
    return re.compile(_char_class(sorted({c for codec in CODECS if codec not in OWN_SCRIPT for c in high_half(codec)})) + "+")


#: Scripts whose own words may look like a garbled letter in these encodings.
OWN_SCRIPT = {"cp1251": re.compile("[Ѐ-џ]"), "cp932": re.compile("[ｦ-ﾟ]")}


def other_letters(decoded: str, n_bytes: int, codec: str) -> bool:
    """Whether a span is two or more assigned letters or symbols of three bytes each, or four: no chance of that in text whose own script the codec is not."""
    return codec not in OWN_SCRIPT and len(decoded) > 1 and n_bytes >= 3 * len(decoded) and all(unicodedata.category(c)[0] in "LMNS" for c in decoded)


def garbled_spans(text: str, codec: str) -> tuple[list[tuple[int, int, str, bool]], int]:
    """Spans (start, end, decoded, beyond doubt) of UTF-8 read as ``codec``, and how many of them are beyond doubt.

    A span is in doubt if it could be a letter next to a closing sign: one sequence
    of two bytes that does not stand inside a word. Other scripts need two letters.
    """
    spans, sure = [], 0
    if not pair_pattern(codec).search(text):
        return spans, sure
    own = OWN_SCRIPT.get(codec)
    for m in SPAN.finditer(text.translate(to_bytes(codec))):
        a, b = m.span()
        decoded = m.group().encode("latin-1").decode("utf-8")
        several = len(decoded) > 1
        if not PLAUSIBLE.fullmatch(C1.sub("", decoded) if several else decoded) and not (several and shown_by_codecs().fullmatch(decoded)) and not other_letters(decoded, b - a, codec):
            continue
        before, after = text[a - 1 : a] if a else "", text[b : b + 1]
        if len(decoded) == 1 and b - a == 2:
            if OTHER_SCRIPT.match(decoded) or (own and (own.match(before) or own.match(after))):
                continue
        inside = after.isalpha() or (before.isalpha() and before.islower() and not text[a].islower())
        spans.append((a, b, decoded, several or b - a > 2 or inside))
        sure += spans[-1][3]
    return spans, sure


def repair_multibyte(text: str, used: set[str] | None = None) -> tuple[str, int]:
    """The text with all garbled multibyte spans decoded, and their number; however often it was garbled, as each round shortens it.

    An encoding takes part in a round if the text has a span of it beyond doubt, or
    several. In each line the one that explains most is decoded, of equals the one
    that explains most of the text. A span that lies inside a longer one of another
    encoding waits for that one's round. ``used`` gets the encodings.
    """
    total = 0
    while True:
        found = {}
        for codec in CODECS:
            spans, sure = garbled_spans(text, codec)
            if sure or len(spans) > 1:
                found[codec] = spans
        if not found:
            break
        whole = {codec: sum(len(d) + ok for _, _, d, ok in spans) for codec, spans in found.items()}
        lines = [i for i, c in enumerate(text) if c == "\n"] if len(found) > 1 else []
        by_line: dict[int, dict[str, list]] = {}
        for codec, spans in found.items():
            for span in spans:
                by_line.setdefault(bisect_left(lines, span[0]), {}).setdefault(codec, []).append(span)
        best = []
        for some in by_line.values():
            codec = max(some, key=lambda c: (sum(len(d) + ok for _, _, d, ok in some[c]), whole[c]))
            longer = [(a, b) for other, spans in some.items() if other != codec for a, b, *_ in spans]
            outer = [x for x in some[codec] if not any(a <= x[0] and x[1] <= b and b - a > x[1] - x[0] for a, b in longer)]
            best += outer or some[codec]
            if used is not None:
                used.add(codec)
        parts, at = [], 0
        for a, b, decoded, _ in sorted(best):
            parts += [text[at:a], decoded]
            at = b
        text = "".join([*parts, text[at:]])
        total += len(best)
    return text, total


#: A word with Latin and Cyrillic letters: Western bytes read as cp1251.
MIXED = re.compile(f"[{LATIN}]['’-]?[{CYRILLIC}]|[{CYRILLIC}]['’-]?[{LATIN}]")
CYRILLIC_WORD = re.compile(f"[{LATIN}{CYRILLIC}'’-]*[{CYRILLIC}][{LATIN}{CYRILLIC}'’-]*")
FROM_1251 = {ord(c): bytes([b]).decode("cp1252", "replace") for b, c in enumerate(high_half("cp1251"), 128) if re.match(f"[{CYRILLIC}]", c)}


def repair_cyrillic(text: str) -> tuple[str, int]:
    """Cyrillic letters inside Latin words back to the Western letters of the same bytes."""
    if not MIXED.search(text):
        return text, 0
    n = 0

    def word(m: re.Match) -> str:
        nonlocal n
        w = m.group()
        letters = re.sub("['’-]", "", w)
        if len(letters) > 1 and not re.search(f"[{LATIN}]", letters):
            return w
        n += 1
        return w.translate(FROM_1251)

    return CYRILLIC_WORD.sub(word, text), n


#: Signs that no word has inside: Mac bytes read as cp1252. Alone at the start of a word some are footnote marks.
MAC_INSIDE = re.compile(
    f"(?<=[{LATIN}])[\x80-\x9f‡ˆ‰‹›•™\xa7\xbe\xbf\xaf\xae‚„†ƒ“”˜](?=[{LOWER}])"
    f"|(?<=[{LOWER}])[ŠŽŸŒ](?=[{LOWER}\\W\x80-\x9f]|$)|(?<=[{LATIN}])[ŽŸŒ](?=[{LOWER}])|[{LATIN}][\x80-\x9f]|[\x80-\x9f][{LATIN}]"
    f"|(?<=[{LOWER}])[–—](?=[{LOWER}])|(?<![^\\s{{(~-])[†‡‚„…ƒ](?=[{LOWER}]{{2}})"
)
MAC_HIGH = high_half("mac_roman")
FROM_MAC = {ord(c): MAC_HIGH[b - 128] for b, c in enumerate(high_half("cp1252"), 128)}
#: Western letters that are letters either way.
EITHER = "šžœŠŽŸŒ"
GUESSED = re.compile(f"[šžœ]|(?<![{LATIN}])[ŠŽŸŒ]")
VOWELS = "aeiouy\xe4\xf6\xfc\xe5\xe6\xf8\xe1\xe9\xed\xf3\xfa\xe0\xe8\xea\xee\xef\xf4\xfb"


#: A Western letter that stands right inside a word shows that its line is not Mac text read as cp1252.
RIGHT_LETTER = re.compile(f"(?<=[{LOWER}])[à-öø-ÿ]|[à-öø-ÿ](?=[a-z])")


def repair_mac(text: str, untouched: list[bool] | None = None) -> tuple[str, int]:
    """Mac Western bytes read as cp1252, back to what they were, if a word shows it.

    Lines that show it are restored; so are all others where no letter of the text
    stands right inside a word, that is where the whole text was read wrongly.
    With ``untouched`` only lines for which it is true, and that show it themselves.
    """
    if not MAC_INSIDE.search(text):
        return text, 0
    whole = untouched is None and not RIGHT_LETTER.search(text)
    n = 0

    def letter(line: str, i: int) -> str:
        c = line[i]
        d = FROM_MAC.get(ord(c), c) if ord(c) > 127 else c
        if c in EITHER:
            before, after = line[i - 1 : i] if i else "", line[i + 1 : i + 2].lower()
            fits = before.lower() in VOWELS if before.isalpha() else after and after in VOWELS
            if fits and not (c.isupper() and before.islower()):
                return c
        return d

    out = []
    for k, line in enumerate(text.split("\n")):
        if whole or (MAC_INSIDE.search(line) and (untouched is None or untouched[k])):
            fixed = "".join(letter(line, i) for i in range(len(line))) if not line.isascii() else line
            n += sum(x != y for x, y in zip(line, fixed))
            line = fixed
        out.append(line)
    return "\n".join(out), n


LOST = "�"


def left_over(text: str, used: set[str]) -> bool:
    """Whether a text still has a span that could be garbled, a word of two scripts or a sign inside a word; of the encodings it was garbled by any well-formed span of three bytes counts, whatever it means."""
    if MIXED.search(text) or MAC_INSIDE.search(text) or any(garbled_spans(text, c)[0] for c in CODECS):
        return True
    return any(len(m.group()) > 2 for c in used if pair_pattern(c).search(text) for m in SPAN.finditer(text.translate(to_bytes(c))))


def repair(text: str) -> tuple[str, list[str], int, bool]:
    """The restored text, the kinds of damage, the number of restored spans, and whether nothing is left to restore.

    Kinds: ``multibyte`` (UTF-8 read in a one-byte encoding, once or more often),
    ``cyrillic`` and ``mac`` (one-byte encodings mixed up), ``lost`` (replacement
    characters, whose bytes are gone, so the text cannot be restored in full).
    Spans and words of two scripts are restored until none is left, as either may
    bring out the other. The Mac step then takes the lines that were not restored;
    a line with both kinds of damage keeps the second. What the result still has is
    looked at once more, so ``complete`` is about the text that comes out. Nothing
    reaches over a line end, so lines of ASCII are left out of all this.
    """
    lines = text.split("\n")
    at = [i for i, line in enumerate(lines) if not line.isascii()]
    if len(at) < len(lines):
        some, kinds, total, complete = repair("\n".join(lines[i] for i in at)) if at else (text, [], 0, False)
        for i, line in zip(at, some.split("\n")):
            lines[i] = line
        return "\n".join(lines), kinds, total, complete
    kinds, total, given = [], 0, text
    used: set[str] = set()
    while True:
        before = text
        for kind, step in (("multibyte", lambda t: repair_multibyte(t, used)), ("cyrillic", repair_cyrillic)):
            text, n = step(text)
            total += n
            if n and kind not in kinds:
                kinds.append(kind)
        if text == before:
            break
    old, new = given.split("\n"), text.split("\n")
    untouched = None if not kinds else [x == y for x, y in zip(old, new)] if len(old) == len(new) else [False] * len(new)
    unread = text
    text, n = repair_mac(text, untouched)
    # Letters that either encoding may mean are told by their neighbours, which is a guess.
    guessed = any(x != y and GUESSED.search(x) for x, y in zip(unread.split("\n"), text.split("\n")))
    if n:
        kinds.append("mac")
        total += n
    if LOST in text:
        kinds.append("lost")
    return text, kinds, total, bool(kinds) and "lost" not in kinds and not guessed and not left_over(text, used)


def _java_class(chars: set[str]) -> str:
    return "[" + "".join(f"\\x{{{ord(c):x}}}" for c in sorted(chars)) + "]"


def suspicion() -> str:
    """A pattern that every text with any of the damages contains.

    It takes one character outside ASCII and then looks back and ahead, so the
    scan passes over ASCII as fast as it can.
    """
    latin, lower, cyrillic = (f"[{x}]" for x in (LATIN, LOWER, CYRILLIC))
    mac = "[†-•…ˆ‰‹›™\xa7\xbe\xbf\xaf\xae‚„ƒ“”˜ŠŽŸŒ–—]"
    pairs = "|".join(f"(?<={_java_class(set(lead))}){_java_class(set(cont))}" for lead, cont in map(lead_pair, CODECS))
    # Each group looks first at what it needs at all, as most characters are letters inside words.
    groups = (
        f"(?=[^\\x00-\\x7f])(?:{pairs})",
        f"(?<=[{LOST}\\x{{80}}-\\x{{9f}}])",
        f"(?<={cyrillic})(?:(?<={latin}['’-]?.)|['’-]?{latin})",
        f"(?<={mac})(?:(?<={latin}.){lower}|(?<={lower}[ŠŽŸŒ])|(?<=[†‡‚„…ƒ])(?<![^\\s{{(~-].){lower})",
    )
    return "[^\\x00-\\x7f](?:" + "|".join(groups) + ")"


def find_garbled(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key``, ``kinds``, ``n_restored``, ``restored`` and ``complete`` of the rows whose text is garbled.

    A pattern on the JVM side leaves the texts with any suspicious pair of
    characters; only those go to Python. Null and empty texts are never garbled;
    texts of any length are read whole; repeated rows come out repeated.
    ``complete`` is false where characters were lost for good or the restored text
    still looks garbled somewhere. Where two encodings
    explain the same number of characters the first of ``CODECS`` is taken. An empty
    table gives no row; other columns are not read.
    """

    def fix(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, *repair(t)) for k, t in zip(batch["k"], batch["t"])]
            rows = [(k, kinds, n, fixed, complete) for k, fixed, kinds, n, complete in rows if kinds]
            yield pd.DataFrame(rows, columns=["k", "kinds", "n_restored", "restored", "complete"])

    kind = df.schema[key].dataType
    suspects = df.select(F.col(key).cast("string").alias("k"), F.col(text).alias("t")).where(F.col("t").rlike(suspicion()))
    return suspects.mapInPandas(fix, "k string, kinds array<string>, n_restored long, restored string, complete boolean").withColumn("k", F.col("k").cast(kind)).withColumnRenamed("k", key)
