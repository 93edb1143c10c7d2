"""Chains of a wrong reading: which texts a stretch of garbled text may have been.

A chain is (read, written): bytes written in one encoding were read in another. Undone, each of the longest runs of
characters that the reading encoding holds is turned back to bytes and decoded as it was written. Strings are undone one by one;
chains between single-byte encodings, which apply to nearly everything, are undone for many stretches at once on
arrays of code points.
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator

import numpy as np

#: Encodings that texts are wrongly read in, and legacy encodings that texts are written in.
READ_AS = ("cp1252", "latin_1", "cp1251", "mac_roman", "cp437", "cp850", "cp1250", "iso8859_2", "koi8_r", "cp866", "cp1253", "cp1254", "gb18030")
WRITTEN_IN = {
    "cp1251": ("cp1252", "latin_1", "koi8_r", "cp866", "mac_roman", "cp1253", "cp1250"),
    "koi8_r": ("cp1252", "latin_1", "cp1251", "cp866", "mac_roman"),
    "cp866": ("cp1252", "latin_1", "cp1251", "koi8_r", "mac_roman", "cp437", "cp850"),
    "mac_cyrillic": ("cp1252", "latin_1", "cp1251", "mac_roman"),
    "iso8859_5": ("cp1252", "latin_1", "cp1251", "koi8_r"),
    "cp1253": ("cp1252", "latin_1", "mac_roman", "cp1251"),
    "cp737": ("cp1252", "latin_1", "cp437"),
    "cp1250": ("cp1252", "latin_1", "cp1251"),
    "iso8859_2": ("cp1252", "latin_1", "cp1250"),
    "cp852": ("cp1252", "latin_1", "cp850", "cp437"),
    "cp932": ("cp1252", "latin_1", "mac_roman", "cp437", "cp850", "cp1251"),
    "euc_jp": ("cp1252", "latin_1", "mac_roman", "cp1251"),
    "cp1252": ("cp437", "cp850", "mac_roman", "cp1251", "cp1250", "cp1253", "koi8_r", "gb18030"),
    "mac_roman": ("cp1252", "latin_1"),
    "cp437": ("cp1252", "latin_1"),
    "cp850": ("cp1252", "latin_1", "cp437"),
}
#: Kinds of candidates: whole runs are UTF-8; some sequences in them are; bytes had been lost; a legacy chain.
WHOLE, PART, LOST, LEGACY = range(4)
#: Bytes whose characters are often removed or turned into blanks: controls, no-break space, soft hyphen.
LOST_BYTES = (*range(0x80, 0xA1), 0xAD)
#: Lone lead characters are put right along the best so many ways.
BEAM = 40


def _table(codec: str) -> dict[int, int]:
    """Character to byte; bytes that the codec leaves undefined stand for the control of that number."""
    out: dict[int, int] = {}
    for b in range(256):
        try:
            out[ord(bytes([b]).decode(codec))] = b
        except UnicodeDecodeError:
            out.setdefault(b, b)
    return out


_TABLES = {c: _table(c) for c in READ_AS if c != "gb18030"}


def to_bytes(text: str, codec: str) -> bytes | None:
    """The bytes that were read as `text` in the codec, or None."""
    if codec == "gb18030":
        try:
            return text.encode(codec)
        except UnicodeEncodeError:
            return None
    table = _TABLES[codec]
    try:
        return bytes([table[ord(c)] for c in text])
    except KeyError:
        return None


def from_bytes(raw: bytes, codec: str) -> str:
    """The bytes read in a single-byte codec, undefined ones as controls; raises UnicodeDecodeError otherwise."""
    if codec in _TABLES:
        back = _BACK.setdefault(codec, {b: chr(c) for c, b in _TABLES[codec].items()})
        return "".join(back.get(b, chr(b)) for b in raw)
    return raw.decode(codec)


_BACK: dict[str, dict[int, str]] = {}


def runs(text: str, codec: str) -> list[tuple[int, int]]:
    """(start, end) of the longest runs of characters in the codec that hold one beyond ASCII, two if it isn't the whole text."""
    if text.isascii():
        return []
    if codec not in _RUNS:
        held = "".join(map(re.escape, map(chr, _TABLES[codec]))) if codec in _TABLES else "\x00-\ud7ff\ue000-\U0010ffff"
        _RUNS[codec] = re.compile(f"[{held}]+")
    found = [m.span() for m in _RUNS[codec].finditer(text)]
    return [(i, j) for i, j in found if j - i - len(text[i:j].encode("ascii", "ignore")) > (j - i < len(text))]


_RUNS: dict[str, re.Pattern] = {}
#: Bytes of one character beyond ASCII in UTF-8.
_UTF8 = re.compile(rb"(?:[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2})+")




def _sequence_gates() -> dict[str, re.Pattern]:
    """What every run with a UTF-8 sequence holds, by single-byte encoding: a lead byte and one that continues it."""
    gates = {}
    for codec, table in _TABLES.items():
        lead = "".join(re.escape(chr(c)) for c, b in table.items() if 0xC2 <= b <= 0xF4)
        follow = "".join(re.escape(chr(c)) for c, b in table.items() if 0x80 <= b <= 0xBF)
        gates[codec] = re.compile(f"[{lead}][{follow}]")
    return gates


_GATES = _sequence_gates()


def may_be_utf8(text: str, codec: str) -> bool:
    """False only where no run of the text, read in the codec, holds a UTF-8 sequence."""
    if codec in _GATES:
        return bool(_GATES[codec].search(text))
    try:
        text.encode(codec).decode("utf_8")
    except UnicodeError:
        return False
    return True


def utf8_candidates(text: str, depth: int = 2, whole: bool = False) -> Iterator[tuple[str, int]]:
    """(candidate, kind) of the chains that end in UTF-8, once or twice over. whole: only runs that decode as a whole."""
    for read in READ_AS:
        if not may_be_utf8(text, read):
            continue
        made: list[str] = []
        parts: list[str] = []
        done = 0
        for i, j in runs(text, read):
            raw = to_bytes(text[i:j], read)
            made.append(text[done:i])
            parts.append(text[done:i])
            done = j
            try:
                new = raw.decode("utf_8")
                part = new
            except UnicodeDecodeError:
                new, part = text[i:j], text[i:j] if whole or read == "gb18030" else sequences(text[i:j], raw)
            made.append(new)
            parts.append(part)
        whole_runs, in_part = ("".join([*x, text[done:]]) for x in (made, parts))
        for out, kind in ((whole_runs, WHOLE), *([(in_part, PART)] if in_part != whole_runs else [])):
            if out != text:
                yield out, kind
                if depth > 1 and not out.isascii():
                    yield from ((o, max(k, kind)) for o, k in utf8_candidates(out, depth - 1, whole))


def sequences(text: str, raw: bytes) -> str:
    """The text, one character a byte of raw, with what is UTF-8 in raw decoded and the rest as it stands.

    A no-break space after a letter beyond Latin-1 stands for itself.
    """
    out, done = [], 0
    for m in _UTF8.finditer(raw):
        if "\xa0" in text[m.start() : m.end()] and text[m.start()] > "\xff":
            continue
        out += [text[done : m.start()], m.group().decode("utf_8")]
        done = m.end()
    return "".join([*out, text[done:]])


CHAINS = tuple((read, written) for written, reads in WRITTEN_IN.items() for read in reads)


#: Of several bytes a character: what isn't valid in between stays as it stands.
_WIDE = ("cp932", "euc_jp")


def legacy_text(text: str, read: str, written: str) -> str | None:
    """The text by one chain, run by run, or None where the chain doesn't apply or changes nothing."""
    made, done = [], 0
    for i, j in runs(text, read):
        raw = to_bytes(text[i:j], read)
        try:
            new = raw.decode(written)
        except UnicodeDecodeError:
            new = kept(text[i:j], raw, written) if written in _WIDE else text[i:j]
        made += [text[done:i], new]
        done = j
    whole = "".join([*made, text[done:]])
    return whole if whole != text else None


def legacy_texts(text: str) -> list[str | None]:
    """The text by each of CHAINS."""
    return [legacy_text(text, *chain) for chain in CHAINS]


def kept(text: str, raw: bytes, codec: str) -> str:
    """raw decoded, with the characters of text, one for each byte, where it isn't valid."""
    _kept_text.append(text)
    try:
        return raw.decode(codec, "tidemark_kept")
    finally:
        _kept_text.pop()


_kept_text: list[str] = []
codecs.register_error("tidemark_kept", lambda e: (_kept_text[-1][e.start : e.end], e.end))


def _lost_candidates() -> dict[str, tuple[str, ...]]:
    """What a lone lead character may have been before the controls or blanks after it were lost."""
    out: dict[str, list[str]] = {}
    for lead in range(0xC2, 0xE0):
        for b in LOST_BYTES:
            c = bytes([lead, b]).decode("utf_8")
            if c.isalpha() or c == " ":
                out.setdefault(chr(lead), []).append(c)
    for b in LOST_BYTES:
        out.setdefault("â", []).append(bytes([0xE2, 0x80, b]).decode("utf_8", "ignore"))
    return {k: tuple(dict.fromkeys(x for x in v if x and x.isprintable() or x == " ")) for k, v in out.items()}


LEADS = _lost_candidates()


def _lost_between() -> dict[str, tuple[str, ...]]:
    """What a lead character and a visible one that continues it may have been before a byte between or after them was lost."""
    out: dict[str, list[str]] = {}
    for lead in range(0xE2, 0xF0):
        for seen in (b for b in range(0xA1, 0xC0) if b != 0xAD):
            for b in LOST_BYTES:
                for raw in (bytes([lead, b, seen]), bytes([lead, seen, b])):
                    c = raw.decode("utf_8", "ignore")
                    if len(c) == 1 and c.isprintable():
                        out.setdefault(chr(lead) + chr(seen), []).append(c)
    return {k: tuple(dict.fromkeys(v)) for k, v in out.items()}


PAIRS = _lost_between()


# -- many stretches at once ---------------------------------------------------------------------------------------


class Flat:
    """Texts as one array of code points, each as NUL, blank, its characters, blank."""

    def __init__(self, points: np.ndarray, lengths: np.ndarray):
        """lengths: of the texts with the three characters around them."""
        self.points, self.lengths = points, lengths
        self.starts = np.cumsum(lengths) - lengths

    @classmethod
    def of(cls, texts: list[str]) -> Flat:
        joined = "".join(f"\x00 {t} " for t in texts)
        return cls(np.frombuffer(joined.encode("utf_32_le", "surrogatepass"), np.uint32), np.fromiter(map(len, texts), np.int64, len(texts)) + 3)

    def sums(self, flags: np.ndarray) -> np.ndarray:
        """Sums of an array over the characters, by text."""
        return np.add.reduceat(flags, self.starts, axis=0, dtype=np.int64 if flags.dtype == bool else None) if len(self.starts) else flags[:0]

    def take(self, which: np.ndarray, points: np.ndarray | None = None) -> Flat:
        """The texts where `which` is true, with other characters in their places if given."""
        return Flat((self.points if points is None else points)[np.repeat(which, self.lengths)], self.lengths[which])

    def digests(self) -> np.ndarray:
        """A 64-bit number of every text."""
        place = np.arange(len(self.points)) - np.repeat(self.starts, self.lengths)
        x = (self.points.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) * (place.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(0xCA5A826395121157))
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return np.add.reduceat(x ^ (x >> np.uint64(32)), self.starts) if len(self.starts) else x


_NARROW = tuple(c for c in _TABLES)
#: By reading encoding: the byte of every character of the first plane, or -1.
_BYTE_OF = {c: np.full(65536, -1, np.int16) for c in _NARROW}
for _c in _NARROW:
    _BYTE_OF[_c][list(_TABLES[_c])] = list(_TABLES[_c].values())
_NONE = np.uint32(0xFFFFFFFF)


def _points(codec: str) -> np.ndarray:
    """The character of every byte, _NONE for undefined ones."""
    out = np.full(256, _NONE, np.uint32)
    for b in range(256):
        try:
            out[b] = ord(bytes([b]).decode(codec))
        except UnicodeDecodeError:
            pass
    return out


_CHAR_OF = {w: _points(w) for w in WRITTEN_IN if w not in _WIDE}


def legacy_many(texts: list[str], flat: Flat) -> Iterator[tuple[int, np.ndarray, Flat]]:
    """(chain, which texts it changes, what they become) for every chain; flat: of the texts."""
    points, size = flat.points, flat.lengths - 3
    inner = np.ones(len(points), bool)
    for shift in (0, 1):
        inner[flat.starts + shift] = False
    inner[flat.starts + flat.lengths - 1] = False
    text_of = np.repeat(np.arange(len(flat.lengths)), flat.lengths)
    beyond = points > 127
    for read in READ_AS:
        wanted = [(n, written) for n, (r, written) in enumerate(CHAINS) if r == read]
        if read not in _BYTE_OF:
            for n, written in wanted:
                yield _one_by_one(n, read, written, texts)
            continue
        byte = np.where(inner & (points < 65536), _BYTE_OF[read][np.minimum(points, 65535)], -1)
        held = byte >= 0
        first = held.copy()
        first[1:] &= ~held[:-1]
        at = np.flatnonzero(held)
        run = np.cumsum(first)[at] - 1
        n_runs = int(first.sum())
        length = np.bincount(run, minlength=n_runs)
        owner = text_of[np.flatnonzero(first)]
        good = np.bincount(run, beyond[at], minlength=n_runs) > (length < size[owner])
        at, run = at[good[run]], run[good[run]]
        raw = byte[at]
        # the usable runs in order: text, first and behind the last character in it, their bytes
        cuts = np.flatnonzero(np.diff(run, prepend=-1))
        ends = np.append(cuts[1:], len(run))
        origin = at[cuts] - flat.starts[owner[run[cuts]]] - 2
        pieces = list(zip(owner[run[cuts]].tolist(), origin.tolist(), (origin + ends - cuts).tolist(), cuts.tolist(), ends.tolist()))
        as_bytes = raw.astype(np.uint8).tobytes()
        for n, written in wanted:
            if written not in _CHAR_OF:
                yield _wide(n, written, texts, pieces, as_bytes)
                continue
            made = _CHAR_OF[written][raw]
            broken = np.zeros(n_runs, bool)
            broken[run[made == _NONE]] = True
            new = points.copy()
            keep = ~broken[run]
            new[at[keep]] = made[keep]
            changed = flat.sums(new != points) > 0
            yield n, np.flatnonzero(changed), flat.take(changed, new)


def _one_by_one(n: int, read: str, written: str, texts: list[str]) -> tuple[int, np.ndarray, Flat]:
    found = [(i, made) for i, t in enumerate(texts) if (made := legacy_text(t, read, written)) is not None]
    return n, np.array([i for i, _ in found], np.int64), Flat.of([t for _, t in found])


def _wide(n: int, written: str, texts: list[str], pieces: list[tuple[int, int, int, int, int]], raw: bytes) -> tuple[int, np.ndarray, Flat]:
    """By an encoding of several bytes a character. pieces: (text, from, to, from, to in raw) of the runs, in order."""
    made: dict[int, list] = {}
    for i, a, b, x, y in pieces:
        text = texts[i]
        try:
            new = raw[x:y].decode(written)
        except UnicodeDecodeError:
            new = kept(text[a:b], raw[x:y], written)
        done = made.setdefault(i, [0, ""])
        made[i] = [b, f"{done[1]}{text[done[0]:a]}{new}"]
    found = [(i, whole) for i, (b, out) in made.items() if (whole := out + texts[i][b:]) != texts[i]]
    return n, np.array([i for i, _ in found], np.int64), Flat.of([t for _, t in found])
