"""Text decoded with the wrong encoding: find it, and restore it where possible.

Runs of non-ASCII characters are mapped back to the bytes of a legacy code page. A
byte-structure automaton finds the maximal well-formed multibyte spans in them, and
only these spans are decoded; the rest of the line stays as it is. Text garbled
several times is restored in several rounds. Two more kinds leave their mark without
multibyte structure: single-byte text read in another single-byte code page, which
shows as letters that no language joins, and characters already lost, which can be
reported but not restored.
"""

from __future__ import annotations

import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_RUN = re.compile(r"[^\x00-\x7f]+")

#: The well-formed byte sequences of UTF-8 beyond ASCII (Unicode standard, table 3-7).
_UTF8 = re.compile(
    rb"(?:[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]"
    rb"|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2})+"
)

#: Code pages that text is commonly misread in, the likelier first.
CODE_PAGES = ("cp1252", "cp437", "cp850", "mac_roman", "cp1251", "cp1250", "iso8859_2", "koi8_r", "cp866", "cp1254")


def _byte_map(codec: str) -> dict[int, int]:
    """Code point -> byte of the upper half; bytes without a character map as in latin-1."""
    out = {}
    for b in range(0x80, 0x100):
        try:
            out[ord(bytes([b]).decode(codec))] = b
        except UnicodeDecodeError:
            pass
    for b in range(0x80, 0x100):
        out.setdefault(b, b) if b not in out and codec in ("cp1252", "cp1254", "cp1250", "cp1251") and b < 0xA0 else None
    return out


_MAPS = {c: _byte_map(c) for c in CODE_PAGES}
_CYRILLIC_PAGES = ("cp1251", "koi8_r", "cp866")
_CYRILLIC = set("абвгдежзийклмнопрстуфхцчшщъыьэюяАБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯёЁ")


def _plausible(ch: str) -> bool:
    """Is this what text means to say, rather than a chance product of decoding?"""
    o = ord(ch)
    if o < 0x80:
        return True
    if o < 0x180:  # Latin-1 and Extended-A; a control is a step of text garbled twice
        return True
    if 0x386 <= o <= 0x3CE or ch in _CYRILLIC:
        return True
    if 0x2010 <= o <= 0x2044 or 0x20A0 <= o <= 0x20BF or 0x2100 <= o <= 0x214F or 0x2190 <= o <= 0x22FF:
        return True
    if 0x2460 <= o <= 0x27BF or 0x3000 <= o <= 0x30FF or 0x4E00 <= o <= 0x9FFF or 0xFF00 <= o <= 0xFFEE:
        return True
    return 0xFE00 <= o <= 0xFE0F or 0x1F000 <= o <= 0x1FAFF or o == 0xFEFF


def _read_spans(run: str, codec: str) -> list[tuple[int, int, str]]:
    """Spans of a run that are well-formed UTF-8 in the bytes of the code page, decoded."""
    table = _MAPS[codec]
    raw = bytes(table.get(ord(c), 0) for c in run)
    out = []
    for m in _UTF8.finditer(raw):
        text = m[0].decode("utf-8")
        if codec in ("koi8_r", "cp866") and any(c not in _CYRILLIC and not (0xA0 <= ord(c) <= 0x17F or 0x2010 <= ord(c) <= 0x2122) for c in text):
            continue  # three or four Cyrillic letters in a row also make a well-formed rare character
        if all(map(_plausible, text)):
            out.append((m.start(), m.end(), text))
    return out


def _fix_utf8(line: str) -> tuple[str, int]:
    """Best single code page for the line; spans decoded, number of characters won."""
    best, won = line, 0
    runs = [(m.start(), m.end()) for m in _RUN.finditer(line)]
    for codec in CODE_PAGES:
        edits = []
        for a, b in runs:
            if b - a > 1:
                edits += [(a + s, a + e, t) for s, e, t in _read_spans(line[a:b], codec)]
        if not edits:
            continue
        if codec in _CYRILLIC_PAGES:
            # a pair such as "Р»" also stands in Russian text: want one that does not
            odd = sum(1 for a, b, _ in edits for c in line[a:b] if c not in _CYRILLIC and c not in "«»—–…“”№ ")
            if odd < 1 or odd + len(edits) < 3:
                continue
        n = sum(e - s for s, e, _ in edits)
        if n > won:
            out, at = [], 0
            for s, e, t in edits:
                out += [line[at:s], t]
                at = e
            best, won = "".join(out) + line[at:], n
    return best, won


_CJK = re.compile(r"[㐀-鿿豈-﫿-]+")


def _fix_gbk(line: str) -> tuple[str, int]:
    """UTF-8 bytes that were read as GBK pairs, with any ASCII between them."""
    best, won = line, 0
    for m in _CJK.finditer(line):
        run = m[0]
        try:
            raw = run.encode("gb18030")
            text = raw.decode("utf-8")
        except UnicodeError:
            continue
        if len(text) and all(map(_plausible, text)) and not text.isascii():
            best = best.replace(run, text)
            won += len(run)
    return best, won


_WIDE = re.compile(r"[^\x00-\xff]{4,}")


def _fix_utf16(line: str) -> tuple[str, int]:
    """Single-byte text whose byte pairs were read as UTF-16 code units."""
    for m in _WIDE.finditer(line):
        run = m[0]
        for codec in ("utf-16-le", "utf-16-be"):
            try:
                raw = run.encode(codec)
            except UnicodeError:
                continue
            good = sum(97 <= b <= 122 or b in (32, 95, 10, 46, 44, 45) for b in raw)
            plain = sum(32 <= b < 127 or b in (9, 10, 13) for b in raw)
            if good >= 0.7 * len(raw) and plain >= 0.85 * len(raw):
                try:
                    text = raw.decode("utf-8")
                except UnicodeDecodeError:
                    text = raw.decode("cp1252", "replace")
                return line.replace(run, text), len(run)
    return line, 0


_LATIN_RUN = re.compile(r"[À-ÖØ-öø-ÿ¸¨]{3,}")
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿĀ-ž"
#: Letters of two scripts within a word (Latin identifiers beside Cyrillic or Chinese are set apart or at word ends).
_MIXED = re.compile(r"[A-Za-z][А-яЁёЂ-џ][A-Za-z]|[a-z][А-яЁё]{1,2}[a-z]|(?<![А-яЁё])[А-яЁё][a-z]{2,}")
#: Signs that no language puts inside a word, by the code page that makes letters of them.
_INSIDE = re.compile(rf"[{_LETTERS}][³¹¿¼¶¥£¦¯ª‚„”“‡†‰ˆ‹›¢¤¬±Ł÷ⁿ▀Σ≤≥φτΘ⌡⌠∩√Ω∂∑∏π∫≈◊¡˜ﬁﬂŸƒ°][a-zà-öø-ÿ]")
_CONTROL = re.compile(r"[\x80-\x84\x86-\x9f]")

#: Letters of Russian by falling frequency.
_FREQUENT = "оеаинтсрвлкмдпуяыьгзбчйхжшюцщэфъё"
_RANK = {c: i for i, c in enumerate(_FREQUENT)}
_BOX_AS_LETTERS = re.compile("ЂЂ")


def _mean_rank(text: str) -> float:
    """Mean frequency rank of the Cyrillic letters; written language is low. Odd case counts against it."""
    ranks = [_RANK[c] for c in text.lower() if c in _RANK]
    odd = len(re.findall("[а-яё][А-ЯЁ]", text)) + len(re.findall("[Ђ-Џђ-џ]", text)) * 2
    return (sum(ranks) + 12 * odd) / len(ranks) if ranks else 99.0


def _fix_cyrillic(line: str, few: bool = False) -> str | None:
    """A line of one Cyrillic code page read in another; ``few``: also one of a few letters."""
    letters = sum(c in _CYRILLIC for c in line)
    box = bool(_BOX_AS_LETTERS.search(line))
    if letters < 3 and not box:
        return None
    # frequencies of few letters say little: the fewer they are, the more must be won, less if their case is upside down
    margin = 2.5 if few else 2.5 * max(1.0, math.sqrt((6 if re.search("[а-яё][А-ЯЁ]", line) else 14) / max(1, letters)))
    best, top = None, _mean_rank(line) - margin
    for wrong in ("cp1251", "koi8_r", "cp866", "mac_cyrillic", "iso8859_5"):
        for right in ("koi8_r", "cp1251", "cp866", "iso8859_5", "mac_cyrillic"):
            if wrong == right:
                continue
            try:
                text = line.encode(wrong).decode(right)
            except UnicodeError:
                continue
            if box and "──" in text:
                return text
            r = _mean_rank(text)
            if margin > 2.5 and sum(map(str.isupper, text)) > sum(map(str.isupper, line)):
                continue  # a lower-case word is hardly one in capitals
            if r < top and sum(c in _CYRILLIC for c in text) >= 0.9 * letters:
                best, top = text, r
    return best


#: Wrong and right code page of single-byte text, tried in this order.
_SINGLE = (("cp1252", "cp1251"), ("latin-1", "cp1251"), ("cp1252", "koi8_r"), ("cp1252", "gb18030"), ("cp1252", "cp1250"), ("latin-1", "iso8859_2"), ("cp1251", "cp1252"), ("cp437", "cp1252"), ("cp850", "cp1252"), ("cp1252", "cp437"), ("cp1252", "cp850"), ("cp1252", "mac_roman"), ("mac_roman", "cp1252"), ("cp1250", "cp1252"))
_COMMON = set("абвгдежзийклмнопрстуфхцчшщыьэюяäöüßéèêàçñóíáúãõâôąćęłńśźżùûîïœ")


def _score(text: str) -> float:
    """How much the non-ASCII part looks like written language."""
    odd = [c for c in text if ord(c) > 127]
    if not odd:
        return 0.0
    good = sum(c in _COMMON or (c.lower() in _COMMON) or 0x4E00 <= ord(c) <= 0x9FFF or c in "，。；：？！（）" for c in odd)
    bad = len(_LATIN_RUN.findall(text)) + len(_INSIDE.findall(text)) + len(_MIXED.findall(text)) + len(_CONTROL.findall(text))
    camel = sum(1 for m in re.finditer(r"[а-я][А-Я]", text))
    return (good - 3 * bad - 2 * camel) / len(odd)


def _fix_single(line: str) -> str | None:
    """The line read in the right single-byte (or GB) code page; None if none helps."""
    best, top = None, _score(line) + 0.2
    for wrong, right in _SINGLE:
        table = _MAPS.get(wrong)
        try:
            raw = bytes(table[ord(c)] if ord(c) > 127 else ord(c) for c in line) if table else line.encode(wrong)
            text = raw.decode(right)
        except (UnicodeError, KeyError):
            continue
        s = _score(text)
        if s > top:
            best, top = text, s
    return best


#: A replacement character, but not one that stands alone in quotes, as code writes it on purpose.
_LOST = re.compile("(?<![\"'`])�|�(?![\"'`])")


def repair_line(line: str) -> tuple[str, str | None]:
    """(restored line, kind); kind None means the line is fine.

    ``multibyte``: spans were decoded; ``single``: read in another single-byte code
    page; ``lost``: garbled, and characters are gone for good (what can be restored is).
    """
    if line.isascii():
        return line, None
    out, kind = line, None
    if _LATIN_RUN.search(line) and (fixed := _fix_single(line)) is not None:
        return fixed, "single"
    for _ in range(4):
        fixed, won = _fix_utf8(out)
        if not won:
            fixed, won = _fix_gbk(out)
        if not won:
            fixed, won = _fix_utf16(out)
        if not won or fixed == out:
            break
        out, kind = fixed, "multibyte"
    if _LOST.search(line) or _LOST.search(out):
        return out, "lost"
    if _LATIN_RUN.search(out) or _MIXED.search(out) or _INSIDE.search(out) or _CONTROL.search(out):
        fixed = _fix_single(out)
        if fixed is not None:
            return fixed, kind or "single"
        return out, "lost"
    if kind is None and (fixed := _fix_cyrillic(line)) is not None:
        return fixed, "single"
    return out, kind


def repair_text(text: str) -> tuple[str, list[int], list[str]]:
    """(restored text, 1-based numbers of garbled lines, their kinds)."""
    if text.isascii():
        return text, [], []
    lines = text.split("\n")
    numbers, kinds = [], []
    for i, line in enumerate(lines):
        fixed, kind = repair_line(line)
        if kind:
            numbers.append(i + 1)
            kinds.append(kind)
            lines[i] = fixed
    if "single" in kinds:  # beside such lines, a few capitals are the rest of a garbled sentence
        for i, line in enumerate(lines):
            if i + 1 not in numbers and re.search("[А-ЯЁ]{3}", line) and not re.search("[а-яё]", line) and (fixed := _fix_cyrillic(line, True)):
                numbers.append(i + 1)
                kinds.append("single")
                lines[i] = fixed
        both = sorted(zip(numbers, kinds))
        numbers, kinds = [n for n, _ in both], [k for _, k in both]
    return "\n".join(lines), numbers, kinds


def garbled_text(df: DataFrame, id_col: str = "chunk_id", text_col: str = "text") -> DataFrame:
    """``<id>, garbled_lines array<int>, kinds array<string>, restored string`` of the affected rows.

    Null, empty and pure ASCII texts are never affected (the latter are filtered in
    the JVM); repeated rows give one row. ``restored`` is the whole text with the
    affected spans replaced; lines of kind ``lost`` keep what cannot be read.
    """
    suspect = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull() & (F.octet_length("text") != F.length("text")))

    def find(it):
        for batch in it:
            rows = []
            for rid, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                fixed, numbers, kinds = repair_text(text)
                if numbers:
                    rows.append((rid, numbers, kinds, fixed))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in rows], pa.string()),
                    pa.array([r[1] for r in rows], pa.list_(pa.int32())),
                    pa.array([r[2] for r in rows], pa.list_(pa.string())),
                    pa.array([r[3] for r in rows], pa.string()),
                ],
                ["id", "garbled_lines", "kinds", "restored"],
            )

    found = suspect.mapInArrow(find, "id string, garbled_lines array<int>, kinds array<string>, restored string")
    return found.dropDuplicates(["id", "restored"]).withColumnRenamed("id", id_col)
