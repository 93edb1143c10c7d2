"""Texts decoded with the wrong character encoding: find them and restore the original where possible.

Character n-gram models (`grams`) are trained on all clean records: those without replacement or control characters and
without a stretch that any UTF-8 chain decodes. Records that a legacy chain garbles pass that test, so no record is
judged by what it taught itself: records fall into folds by their text, copies together, and each is judged by the
counts of the other folds. A stretch is what stands between blanks and holds a character beyond ASCII or an HTML
reference. For each stretch every chain (`chains`) is undone on each of its longest runs of characters that the
encoding holds, once or twice over for UTF-8 (whole runs, or just the sequences in them that are UTF-8); where lead
characters stand alone, the bytes that clean-ups commonly remove are put back behind as many of them as makes the
stretch likeliest. A candidate's gain is its log likelihood less that of the stretch as it stands; chains between
legacy encodings, which nearly always decode, are scored over runs of neighbouring stretches. A record is garbled if
the likeliest candidate of any kind gains more than the margin of its kind.

All that decides is validated on all clean records with characters beyond ASCII, about half of them garbled by random chains in
the tasks, of which sums reach the driver (records that are likelier by SURE after a repair are left out of the clean half): the margin of each kind of candidate is the middle of the widest range that makes the fewest errors, a clean
record counting as CLEAN_WEIGHT garbled ones; what a legacy chain loses by odd neighbours and by stretches it doesn't
apply to is another value than the first only if that saves more than one clean record; and by how much a further stretch of a garbled record may miss its margin is chosen by the number of texts restored exactly.

Work is done on the distinct stretches of a batch of records, on arrays of code points.

Defined results: null, empty and ASCII texts without references are clean; a replacement character (U+FFFD) or a C1
control other than U+0085 makes a record garbled whether or not it can be restored; `restored` is null unless every
garbled stretch was; unusual characters meant as they stand are clean as far as the model tells. Repeated texts get
equal results. An empty table gives no rows; without clean records only the hard signs count. Whole texts are read,
of any length.
"""

from __future__ import annotations

import html
import itertools
import math
import random
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread
from .chains import BEAM, CHAINS, LEADS, LEGACY, LOST, LOST_BYTES, PAIRS, PART, READ_AS, WHOLE, WRITTEN_IN, Flat, from_bytes, legacy_many, legacy_text, utf8_candidates
from .grams import FOLDS, Model, count_grams

#: How much more frequent clean records are taken to be than garbled ones.
CLEAN_WEIGHT = 10
#: A sample record that a repair makes likelier by more than this, on a log scale, is garbled after all and left out.
SURE = 15.0
#: Margins to choose from.
MARGINS = np.arange(0, 24.5, 0.5)
#: Bytes of text that are worked on at once.
BATCH_CHARACTERS = 1 << 24
#: Occurrences of stretches whose runs are summed up at once.
BATCH_OCCURRENCES = 20_000
_BLANK = re.compile(r"[ \t\n\r\f\v]+")
_KEEP = re.compile(r"([ \t\n\r\f\v]+)")
_HARD = re.compile("[�\x80-\x84\x86-\x9f]")
_BEYOND = re.compile(r"[^\x00-\x7f]|&#?\w+;")


def plain(stretch: str) -> str:
    """The stretch with HTML references resolved."""
    return html.unescape(stretch) if "&" in stretch else stretch


def stretches(text: str) -> list[str]:
    return [plain(s) for s in _BLANK.split(text) if not s.isascii() or "&" in s and _BEYOND.search(s)]


def _common(text: str) -> bool:
    """Only characters that plausible texts are made of; ideographs only beside kana or their punctuation."""
    kana = any(0x3000 <= ord(c) < 0x3100 for c in text)
    ok = lambda o: o < 0x180 or 0x370 <= o < 0x530 or 0x2010 <= o < 0x2040 or o in (0x20AC, 0x2122) or 0x2500 <= o < 0x2580 or kana and (0x3000 <= o < 0xA000 or o >= 0xFF00)
    return all(ok(ord(c)) for c in text)


def looks_clean(text: str) -> bool:
    """No hard sign, and no stretch that a UTF-8 chain turns into common characters."""
    if not _BEYOND.search(text):
        return True
    if _HARD.search(text):
        return False
    return not any(decodes(s) for s in set(stretches(text)))


def decodes(stretch: str) -> bool:
    """A UTF-8 chain turns the stretch into common characters."""
    return not stretch.isascii() and any(_common(c) for c, _ in utf8_candidates(stretch, 1, whole=True))


def fold(text: str) -> int:
    """The fold of a record: the same for texts that differ in blanks only."""
    return zlib.crc32("".join(text.split()).encode("utf_8", "surrogatepass")) % FOLDS


# -- candidates and their gains -----------------------------------------------------------------------------------


class Gaps:
    """What may be put back where bytes were lost: the characters of LEADS and PAIRS that the model has seen."""

    def __init__(self, model: Model):
        known = sorted({ord(c) for options in (*LEADS.values(), *PAIRS.values()) for c in options})
        seen = model.count(1, np.array(known, np.int64))[:, -1] > 0
        usable = {chr(c) for c, ok in zip(known, seen) if ok}
        self.leads, self.pairs = ({k: kept for k, v in options.items() if (kept := tuple(c for c in v if c in usable))} for options in (LEADS, PAIRS))
        every = sorted(self.pairs) + sorted(self.leads)
        self.pattern = re.compile("|".join(map(re.escape, every)) if every else "(?!)")


def put_back_once(text: str, gaps: Gaps) -> list[str] | None:
    """All that the text may be with lost bytes put back at its only gap; None where it has several."""
    found = list(gaps.pattern.finditer(text))
    if len(found) > 1 or found and len(found[0].group()) == 2 and (found[0].group()[0] in gaps.leads or gaps.pattern.search(text, found[0].start() + 1)):
        return None
    return [f"{text[: m.start()]}{c}{text[m.end() :]}" for m in found for c in (gaps.leads.get(m.group()) or gaps.pairs[m.group()])]


def put_back(text: str, model: Model, gaps: Gaps) -> str | None:
    """The likeliest text with lost bytes put back at one or more of its gaps; None without any.

    The model looks back two characters, so the best ways to each pair of last characters are carried along the text.
    Where all ways end alike and nothing can be put back, what follows is equally likely after all of them.
    """
    if not gaps.pattern.search(text):
        return None
    leads, pairs = gaps.leads, gaps.pairs
    # by place: (before last, last, whether anything was put back) -> (score, the characters so far as a linked list)
    here: dict[tuple, tuple] = {(0, 32, False): (0.0, None)}
    ahead: dict[tuple, tuple] = {}
    whole = text + " "
    for i, c in enumerate(whole):
        after: dict[tuple, tuple] = {}
        if c not in leads and whole[i : i + 2] not in pairs and not ahead and len({key[:2] for key in here}) == 1:
            x = 0x30 if c.isdecimal() else ord(c)
            here = {(key[1], x, key[2]): (score, (c, so_far)) for key, (score, so_far) in here.items()}
            continue
        options = [(c, False, ahead), *((o, True, ahead) for o in leads.get(c, ())), *((o, True, after) for o in pairs.get(whole[i : i + 2], ()))]
        steps = [(key, o, put, to, (key[0] << 42) | (key[1] << 21) | (0x30 if o.isdecimal() else ord(o))) for key in here for o, put, to in options]
        for (key, o, put, to, code), p in zip(steps, model.log_p_of([s[4] for s in steps])):
            score, so_far = here[key]
            at = (key[1], code & 0x1FFFFF, key[2] or put)
            if at not in to or score + p > to[at][0]:
                to[at] = (score + p, (o, so_far))
        here, ahead = ahead, after
        if len(here) > 2 * BEAM:
            here = dict(w for put in (False, True) for w in sorted((w for w in here.items() if w[0][2] is put), key=lambda w: -w[1][0])[:BEAM])
    found = [w for key, w in here.items() if key[2]]
    if not found:
        return None
    out, link = [], max(found, key=lambda w: w[0])[1][1]
    while link is not None:
        out.append(link[0])
        link = link[1]
    return "".join(reversed(out))


def likeliest_lost(texts: list[str], model: Model) -> dict[int, str]:
    """By number of the text, its likeliest form with lost bytes put back; of a single gap all forms are scored at once."""
    gaps = Gaps(model)
    out: dict[int, str] = {}
    owner: list[int] = []
    once: list[str] = []
    for i, t in enumerate(texts):
        if t.isascii() or not gaps.pattern.search(t):
            continue
        found = put_back_once(t, gaps)
        if found is None:
            out[i] = put_back(t, model, gaps)
        else:
            owner += [i] * len(found)
            once += found
    if once:
        score = model.score(Flat.of([_BLANK.sub(" ", c) for c in once]), as_small=False)[0][:, -1]
        for j in np.lexsort((-np.arange(len(once)), score)).tolist():
            out[owner[j]] = once[j]
    return out


_CLASS = np.zeros(65537, np.uint8)
_LATIN, _OTHER, _SMALL, _CAPITAL = 1, 2, 4, 8
for _bit, _spans in ((_LATIN, ((0x41, 0x5B), (0x61, 0x7B))), (_OTHER, ((0x370, 0x500),)), (_SMALL, ((0x430, 0x452), (0x3AC, 0x3CF))), (_CAPITAL, ((0x410, 0x430), (0x401, 0x402), (0x391, 0x3AA)))):
    for _i, _j in _spans:
        _CLASS[_i:_j] |= _bit


def odd_neighbours(flat: Flat) -> np.ndarray:
    """By text, how many Greek or Cyrillic letters stand beside an unaccented Latin one, or as a capital after a small one."""
    kind = _CLASS[np.minimum(flat.points, 65536)]
    latin = (kind & _LATIN) > 0
    beside = np.zeros(len(kind), bool)
    beside[1:] |= latin[:-1]
    beside[:-1] |= latin[1:]
    late = np.zeros(len(kind), bool)
    late[1:] = ((kind[1:] & _CAPITAL) > 0) & ((kind[:-1] & _SMALL) > 0)
    return flat.sums(((kind & _OTHER) > 0) & beside | late)


@dataclass(frozen=True)
class Rules:
    """What decides, as validated. margins: by kind of candidate."""

    margins: tuple[float, float, float, float] = (2.0, 8.0, 9.0, 6.0)
    #: What an odd neighbour or a new character costs a legacy chain.
    odd: float = 6.0
    #: What a stretch adds to a legacy chain that doesn't apply to it; twice that is the least that any stretch adds.
    not_by_chain: float = -6.0
    #: By how much a further stretch of a garbled record may miss its margin.
    slack: float = 1.0


#: What is tried for the rules beside the margins.
CHOICES = {"odd": (6.0, 3.0, 0.0, 12.0), "not_by_chain": (-6.0, -3.0, -12.0, -24.0)}
SLACKS = (0.0, 1.0, 2.0, 4.0, math.inf)


class Evidence:
    """The candidates of distinct stretches and their gains, by column of the model."""

    def __init__(self, texts: list[str], model: Model):
        self.texts, n = texts, len(texts)
        flat = Flat.of(texts)
        now, new_now = model.score(flat) if n else (np.zeros((0, FOLDS + 1), np.float32),) * 2
        # UTF-8 and lost bytes: the best gain of each kind, and the candidate
        self.gain = np.full((n, 3, FOLDS + 1), -np.inf, np.float32)
        self.best = np.full((n, 3, FOLDS + 1), -1, np.int32)
        self.candidates: list[str] = []
        owner, kinds = [], []
        lost = likeliest_lost(texts, model)
        for i, t in enumerate(texts):
            if t.isascii():
                continue
            found: dict[str, int] = {}
            for c, kind in utf8_candidates(t):
                found[c] = min(kind, found.get(c, kind))
            if i in lost:
                found.setdefault(lost[i], LOST)
            for c, kind in found.items():
                self.candidates.append(c)
                owner.append(i)
                kinds.append(kind)
        if self.candidates:
            gains = model.score(Flat.of([_BLANK.sub(" ", c) for c in self.candidates]))[0] - now[owner]
            slot = np.array(owner) * 3 + np.array(kinds)
            order = np.argsort(slot, kind="stable")
            slots, first = np.unique(slot[order], return_index=True)
            most = np.maximum.reduceat(gains[order], first, axis=0)
            size = np.diff(np.append(first, len(order)))
            at = np.where(gains[order] == np.repeat(most, size, axis=0), order[:, None], len(order))
            self.gain.reshape(-1, FOLDS + 1)[slots] = most
            self.best.reshape(-1, FOLDS + 1)[slots] = np.minimum.reduceat(at, first, axis=0)
        # legacy chains: equal outcomes of several chains are scored once
        self.applies = np.zeros((n, len(CHAINS)), bool)
        self.raw = np.zeros((n, len(CHAINS), FOLDS + 1), np.float32)
        self.odd = np.zeros((n, len(CHAINS), FOLDS + 1), np.int16)
        odd_now = odd_neighbours(flat)
        made = [(chain, which, out) for chain, which, out in legacy_many(texts, flat) if len(which)]
        if made:
            of = np.concatenate([which for _, which, _ in made])
            chain = np.repeat([c for c, _, _ in made], [len(w) for _, w, _ in made])
            every = Flat(np.concatenate([out.points for *_, out in made]), np.concatenate([out.lengths for *_, out in made]))
            digest = every.digests() + of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            _, one, same = np.unique(digest, return_index=True, return_inverse=True)
            chosen = np.zeros(len(digest), bool)
            chosen[one] = True
            place = np.cumsum(chosen) - 1
            distinct = every.take(chosen)
            score, new = model.score(distinct)
            own = of[chosen]
            odd = np.maximum(odd_neighbours(distinct) - odd_now[own], 0)[:, None] + np.maximum(new - new_now[own], 0)
            row = place[one[same]]
            self.applies[of, chain] = True
            self.raw[of, chain] = (score - now[own])[row]
            self.odd[of, chain] = np.minimum(odd, 9999)[row]

    def by_chain(self, rules: Rules) -> np.ndarray:
        """[stretch, chain, column] what each stretch adds to each legacy chain."""
        out = np.where(self.applies[:, :, None], self.raw - np.float32(rules.odd) * self.odd, np.float32(rules.not_by_chain))
        return np.maximum(out, np.float32(2 * rules.not_by_chain))


def best_runs(added: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """By record the most that a chain gains over a run of neighbouring stretches. added: [occurrence, chain]; starts: of the records."""
    out = np.full(len(starts), -np.inf)
    ends = np.append(starts[1:], len(added))
    first = 0
    while first < len(starts):
        upto = max(first + 1, int(np.searchsorted(ends, starts[first] + BATCH_OCCURRENCES, "right")))
        part = added[starts[first] : ends[upto - 1]].astype(np.float64)
        begin = starts[first:upto] - starts[first]
        record = np.repeat(np.arange(upto - first), ends[first:upto] - starts[first:upto])
        sums = np.cumsum(part, axis=0)
        base = np.where(begin[:, None] > 0, sums[np.maximum(begin - 1, 0)], 0.0)
        sums -= base[record]
        before = sums - part
        # the smallest sum before, within the record: later records lie lower by more than any difference
        lower = record[:, None] * (2 * np.abs(sums).max(initial=0) + 2 * np.abs(part).max(initial=0) + 1)
        before = np.minimum.accumulate(before - lower, axis=0) + lower
        out[first:upto] = np.maximum.reduceat((sums - before).max(axis=1), begin)
        first = upto
    return out


class Batch:
    """Records with their stretches, to be judged together."""

    def __init__(self, texts: list[str | None], model: Model):
        self.texts, self.model = texts, model
        index: dict[str, int] = {}
        self.hard = np.array([bool(t) and not t.isascii() and bool(_HARD.search(t)) for t in texts], bool)
        own, rows, starts, folds = [], [], [], []
        for r, t in enumerate(texts):
            if not t or t.isascii() and "&" not in t:
                continue
            found = stretches(t)
            if found:
                rows.append(r)
                folds.append(fold(t))
                starts.append(len(own))
                own.extend(index.setdefault(s, len(index)) for s in found)
        self.rows, self.own, self.starts, self.folds = np.array(rows, np.int64), np.array(own, np.int64), np.array(starts, np.int64), np.array(folds, np.int64)
        self.evidence = Evidence(list(index), model)
        self.of = np.repeat(self.folds, np.diff(np.append(self.starts, len(self.own)))) if rows else self.own

    def gains(self, rules: Rules) -> np.ndarray:
        """[record, kind] the largest gain of each kind."""
        out = np.full((len(self.texts), 4), -np.inf)
        if len(self.rows):
            e = self.evidence
            out[self.rows, :3] = np.maximum.reduceat(e.gain[self.own, :, self.of], self.starts, axis=0)
            self.added = e.by_chain(rules)
            out[self.rows, LEGACY] = best_runs(self.added[self.own, :, self.of], self.starts)
        return out

    def judge(self, rules: Rules, gains: np.ndarray | None = None) -> list[tuple[bool, float | None, str | None]]:
        """(garbled, gain beyond the margin, restored) of each record."""
        if gains is None:
            gains = self.gains(rules)
        beyond = (gains - np.array(rules.margins)).max(axis=1, initial=-np.inf)
        beyond[self.hard] = np.inf
        place = dict(zip(self.rows.tolist(), range(len(self.rows))))
        out = []
        for r, b in enumerate(beyond.tolist()):
            if b > 0:
                out.append((True, None if b == math.inf else b, self._restored(r, place.get(r), rules, gains[r])))
            else:
                out.append((False, None if b == -math.inf else b, None))
        return out

    def _restored(self, r: int, at: int | None, rules: Rules, gains: np.ndarray) -> str | None:
        """The text with its garbled stretches repaired, or None where hard signs remain."""
        parts = _KEEP.split(self.texts[r])
        if at is None:
            return None
        e, k = self.evidence, int(self.folds[at])
        until = self.starts[at + 1] if at + 1 < len(self.starts) else len(self.own)
        own = self.own[self.starts[at] : until]
        chain, first, last = -1, 0, -1
        if gains[LEGACY] > rules.margins[LEGACY]:
            chain, first, last = _likeliest_run(self.added[own, :, k])
        whole = True
        places = [i for i, s in enumerate(parts) if not s.isascii() or "&" in s and _BEYOND.search(s)]
        for n, (i, s) in enumerate(zip(places, own)):
            excess = e.gain[s, :, k] - np.array(rules.margins[:3])
            kind = int(excess.argmax())
            by_chain = self.added[s, chain, k] if first <= n <= last and e.applies[s, chain] else -math.inf
            if excess[kind] > -rules.slack and e.best[s, kind, k] >= 0 and not by_chain > e.gain[s, kind, k]:
                parts[i] = e.candidates[e.best[s, kind, k]]
            elif by_chain > -math.inf:
                parts[i] = legacy_text(e.texts[s], *CHAINS[chain]) or parts[i]
            whole &= not _HARD.search(parts[i])
        return "".join(parts) if whole else None


def _likeliest_run(added: np.ndarray) -> tuple[int, int, int]:
    """(chain, first, last): the run of stretches that a chain makes likelier the most."""
    best, at = -math.inf, (0, 0, -1)
    run, start = np.zeros(added.shape[1]), np.zeros(added.shape[1], np.int64)
    for i, gains in enumerate(added):
        fresh = run <= 0
        run = np.where(fresh, gains, run + gains)
        start[fresh] = i
        k = int(run.argmax())
        if run[k] > best:
            best, at = float(run[k]), (k, int(start[k]), i)
    return at


class Judge:
    """Verdicts on texts by a model and validated rules."""

    def __init__(self, model: Model, rules: Rules):
        self.model, self.rules = model, rules

    def judge_all(self, texts: list[str | None]) -> list[tuple[bool, float | None, str | None]]:
        return Batch(texts, self.model).judge(self.rules)

    def judge(self, text: str | None) -> tuple[bool, float | None, str | None]:
        """(garbled, gain beyond the margin, restored)."""
        return self.judge_all([text])[0]


# -- validation ---------------------------------------------------------------------------------------------------


def garble(text: str, rng: random.Random) -> str:
    """The text, or one stretch of it, garbled by a random chain; the text itself where the chain changes nothing."""
    words = text.split(" ")
    if rng.random() < 0.5:
        at = [i for i, w in enumerate(words) if not w.isascii()]
        if at:
            i = rng.choice(at)
            words[i] = rng.choice((garble_part, garble_lost, garble_all, garble_all))(words[i], rng)
            return " ".join(words)
    return garble_lost(text, rng) if rng.random() < 0.2 else garble_all(text, rng)


def garble_all(text: str, rng: random.Random) -> str:
    written = rng.choice((*("utf_8",) * 3, *WRITTEN_IN))
    read = rng.choice(READ_AS[:-1] if written == "utf_8" else [r for r in WRITTEN_IN[written] if r != "gb18030"])
    try:
        return from_bytes(text.encode(written), read)
    except UnicodeError:
        return text


def garble_part(stretch: str, rng: random.Random) -> str:
    """Some characters of the stretch, one beyond ASCII among them, written in UTF-8 and read otherwise."""
    i = rng.choice([i for i, c in enumerate(stretch) if c > "\x7f"])
    a, b = rng.randint(0, i), rng.randint(i + 1, len(stretch))
    return stretch[:a] + from_bytes(stretch[a:b].encode("utf_8", "surrogatepass"), rng.choice(("cp1252", "latin_1", "cp1251", "mac_roman"))) + stretch[b:]


def garble_lost(text: str, rng: random.Random) -> str:
    """Written in UTF-8, read otherwise, and cleaned of controls, no-break spaces and soft hyphens."""
    raw = text.encode("utf_8", "surrogatepass")
    return from_bytes(bytes(b for b in raw if b not in LOST_BYTES), rng.choice(("cp1252", "latin_1")))


def best_margin(garbled: np.ndarray, clean: np.ndarray, true: int) -> tuple[float, float]:
    """(margin, errors): the middle of the widest range of MARGINS that make the fewest errors.

    garbled, clean: how many records each of MARGINS finds. A clean record that is found counts as CLEAN_WEIGHT garbled
    ones that aren't.
    """
    errors = true - garbled + CLEAN_WEIGHT * clean
    best = errors == errors.min()
    spans = np.flatnonzero(np.diff(np.concatenate([[0], best, [0]]))).reshape(-1, 2)
    a, b = spans[(spans[:, 1] - spans[:, 0]).argmax()]
    return float(MARGINS[(a + b - 1) // 2]), float(errors.min())


def halves(clean: list[str], seed: int) -> list[tuple[str, str]]:
    """(as shown, as it was): of each text itself or a garbled form, by the text alone, so in any order and any task."""
    out: list[tuple[str, str]] = []
    for t in clean:
        rng = random.Random(zlib.crc32(t.encode("utf_8", "surrogatepass")) * 1_000_003 + seed)
        half = rng.random() < 0.5
        other = garble(t, rng) if half else t
        if (other != t) == half and not _HARD.search(other):
            out.append((other, t))
    return out


def tallies(model: Model, clean: list[str], seed: int = 5) -> np.ndarray:
    """[odd, not_by_chain, kind, numbers] of the texts, to be added up over parts of them.

    The numbers: how many garbled ones each of MARGINS finds, how many clean ones, and how many garbled ones there are.
    """
    many = len(MARGINS)
    out = np.zeros((len(CHOICES["odd"]), len(CHOICES["not_by_chain"]), 4, 2 * many + 1), np.int64)
    seen = halves(clean, seed)
    if not seen:
        return out
    batch = Batch([a for a, _ in seen], model)
    garbled = np.array([a != b for a, b in seen], bool)
    usable = garbled | ~(batch.gains(Rules()).max(axis=1) > SURE)
    gains = np.full((len(seen), 4), -np.inf)
    if len(batch.rows):
        e = batch.evidence
        gains[batch.rows, :3] = np.maximum.reduceat(e.gain[batch.own, :, batch.of], batch.starts, axis=0)
        applies, raw, odd = e.applies[batch.own], e.raw[batch.own, :, batch.of], e.odd[batch.own, :, batch.of]
    for i, j in itertools.product(range(out.shape[0]), range(out.shape[1])):
        if len(batch.rows):
            other = np.float32(CHOICES["not_by_chain"][j])
            gains[batch.rows, LEGACY] = best_runs(np.maximum(np.where(applies, raw - np.float32(CHOICES["odd"][i]) * odd, other), 2 * other), batch.starts)
        # a garbled record counts under the kind of candidate that explains it best
        kind = (gains - np.array(Rules().margins)).argmax(axis=1)
        for which in (WHOLE, PART, LOST, LEGACY):
            for at, of in ((0, garbled & (kind == which)), (many, usable & ~garbled)):
                out[i, j, which, at : at + many] = (gains[of, which][:, None] > MARGINS).sum(axis=0)
            out[i, j, which, -1] = (garbled & (kind == which)).sum()
    return out


def chosen(sums: np.ndarray) -> Rules:
    """The rules, but for the slack, that make the fewest errors on what was tallied."""
    many = len(MARGINS)

    def margins(rules: Rules) -> tuple[Rules, float]:
        found = []
        for which, n in enumerate(sums[CHOICES["odd"].index(rules.odd), CHOICES["not_by_chain"].index(rules.not_by_chain)]):
            found.append(best_margin(n[:many], n[many:-1], int(n[-1])) if n[-1] else (Rules().margins[which], 0.0))
        return replace(rules, margins=tuple(m for m, _ in found)), found[LEGACY][1]

    rules, best = margins(Rules())
    for name, values in CHOICES.items():
        for v in values:
            tried, errors = margins(replace(rules, **{name: v}))
            if errors < best - CLEAN_WEIGHT:
                rules, best = tried, errors
    return rules


def restored_exactly(model: Model, rules: Rules, clean: list[str], seed: int = 5) -> np.ndarray:
    """By slack, how many garbled forms of the texts are restored exactly."""
    seen = [(a, b) for a, b in halves(clean, seed) if a != b]
    if not seen:
        return np.zeros(len(SLACKS), np.int64)
    batch = Batch([a for a, _ in seen], model)
    gains = batch.gains(rules)
    return np.array([sum(o[2] == b for o, (_, b) in zip(batch.judge(replace(rules, slack=slack), gains), seen)) for slack in SLACKS], np.int64)


def validated(model: Model, clean: list[str], seed: int = 5) -> Rules:
    """The rules that tell the garbled half of the texts from the clean one, and restore it, best."""
    sums = tallies(model, clean, seed)
    if not sums[..., -1].any():
        return Rules()
    rules = chosen(sums)
    return replace(rules, slack=SLACKS[int(np.argmax(restored_exactly(model, rules, clean, seed)))])


# -- over tables --------------------------------------------------------------------------------------------------


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches (k, t) of about BATCH_CHARACTERS bytes of text, at least one row each."""
    held, size = [], 0
    for b in batches:
        at = 0
        lengths = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(b.column("t")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        while at < b.num_rows:
            done = int(lengths[at - 1]) if at else 0
            upto = max(at + 1, int(np.searchsorted(lengths, done + BATCH_CHARACTERS - size, "right")))
            held.append(b.slice(at, upto - at))
            size += int(lengths[upto - 1]) - done
            at = upto
            if size >= BATCH_CHARACTERS or at < b.num_rows:
                yield pa.Table.from_batches(held).combine_chunks()
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def clean_test() -> Callable[[str], bool]:
    """looks_clean for many texts, that remembers stretches; ASCII texts without references are clean."""
    known: dict[str, bool] = {}

    def clean(t: str) -> bool:
        if t.isascii() and "&" not in t:
            return True
        if _HARD.search(t):
            return False
        if len(known) > 500_000:
            known.clear()
        for s in stretches(t):
            bad = known.get(s)
            if bad is None:
                bad = known[s] = decodes(s)
            if bad:
                return False
        return True

    return clean


def validated_over(src: DataFrame, cell: np.ndarray, counts: np.ndarray) -> Rules:
    """validated upon all clean records of src(t) with characters beyond ASCII; only sums of counts reach the driver."""
    spark = src.sparkSession
    model = spark.sparkContext.broadcast((cell, counts))

    def summed(of: Callable[[Model, list[str]], np.ndarray]) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            here, clean, total = Model(*model.value), clean_test(), 0
            for b in _groups(batches):
                total = total + of(here, [t for t in b.column("t").to_pylist() if t and not t.isascii() and clean(t)])
            if not isinstance(total, int):
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["at", "n"])

        found = src.select("t").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
        out = np.zeros(of(None, []).shape, np.int64)
        out.reshape(-1)[found.column("at").to_numpy()] = found.column("n").to_numpy()
        return out

    sums = summed(tallies)
    if not sums[..., -1].any():
        return Rules()
    rules = chosen(sums)
    return replace(rules, slack=SLACKS[int(np.argmax(summed(lambda here, texts: restored_exactly(here, rules, texts))))])


def train(df: DataFrame, text: str) -> tuple[np.ndarray, np.ndarray]:
    """(cell, counts [cell, fold]) of the grams of all clean records. The cells, a bounded number, come to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clean = clean_test()
        for b in _groups(batches):
            texts = [t for t in b.column("t").to_pylist() if t and clean(t)]
            cell, counts = count_grams(texts, [fold(t) for t in texts])
            yield pa.RecordBatch.from_arrays([pa.array(cell), *(pa.array(c) for c in counts.T)], names=["cell", *(f"w{k}" for k in range(FOLDS))])

    sums = [F.sum(f"w{k}").cast("float").alias(f"w{k}") for k in range(FOLDS)]
    counted = df.select(F.col(text).alias("t")).mapInArrow(count, "cell long, " + ", ".join(f"w{k} double" for k in range(FOLDS)))
    found = counted.groupBy("cell").agg(*sums).toArrow()
    cell = found.column("cell").to_numpy()
    order = np.argsort(cell)
    return cell[order], np.stack([found.column(f"w{k}").to_numpy()[order] for k in range(FOLDS)], axis=1)


def find_garbled(df: DataFrame, key: str, text: str, sample: int | None = None) -> DataFrame:
    """(key, garbled, gain, restored) for every record. The rules are validated on all clean records; with `sample` on
    so many of them."""
    spark = df.sparkSession
    src = spread(df.select(F.col(key).alias("k"), F.col(text).alias("t")))
    cell, counts = train(src, "t")
    if sample is None:
        rules = validated_over(src, cell, counts)
    else:
        beyond = src.where(F.col("t").rlike(r"[^\x00-\x7F]") & ~F.col("t").rlike(r"[�\u0080-\u009F]"))
        picked = beyond.select("t").orderBy(F.xxhash64("t"), "t").limit(2 * sample)
        rules = validated(Model(cell, counts), [r["t"] for r in picked.collect() if looks_clean(r["t"])][:sample])
    shared = spark.sparkContext.broadcast((cell, counts, rules))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, counts, rules = shared.value
        judge = Judge(Model(cell, counts), rules)
        for b in _groups(batches):
            found = judge.judge_all(b.column("t").to_pylist())
            columns = [pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.bool_(), pa.float64(), pa.string()))]
            yield from pa.Table.from_arrays([b.column("k"), *columns], names=["k", "garbled", "gain", "restored"]).to_batches(max_chunksize=10_000)

    out = src.mapInArrow(judge, f"k {dict(src.dtypes)['k']}, garbled boolean, gain double, restored string")
    return out.select(F.col("k").alias(key), "garbled", "gain", "restored")
