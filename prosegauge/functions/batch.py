"""measure() of many texts at once: the same columns, counted in arrays.

The words of a batch are numbered by a table of different words, whose facts are
looked up once; sums by document, by word and by sentence are then array
operations.  What a few sentences or words need beyond (a cue's pattern, a
phrase) is asked of measure.py for those alone, and a text whose letters change
in number or kind when lowered, or that holds the noncharacter between
sentences, is measured by measure() itself.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import measure as M, text as T
from .kernels import phrase_rate, structural_slices

#: Characters of text measured together; a longer text is measured alone.
CHARACTERS = 1 << 20
#: Different words that a process keeps.
KNOWN = 200_000
_MARK = "\uffff"
_ODD = re.compile("[\u0130\u212a\uffff]")
_THERE = re.compile(r"\bthere\s+(is|are|was|were|exists?|existed)\b", re.I | re.A)
_IS = frozenset("is are was were".split())
#: Marks of a word for the patterns that are tried only where they can hold.
_STRONG, _BROAD, _BUT, _HERE, _OPENS, _SUB, _PHRASE, _SECOND = (1 << k for k in range(8))
_SECONDS = {p[1] for p in M.PHRASES}
_CATS = sum(M._CAT_BITS)
#: What makes white-space words.
_INK = np.array([not chr(c).isspace() and c != 0xFFFF for c in range(1 << 16)])
#: Code points whose letters are counted one by one: the lower-case letter, 0 if it is none.
_LOWER = np.array([ord(x) if len(x := chr(c).lower()) == 1 and x.isalpha() else 0 for c in range(1 << 16)], np.uint16)
_LOGS = np.array([0.0, *(c * math.log2(c) for c in range(1, 1 << 12))])
_UNEVEN = re.compile("[\u0130\u03a3\U00010000-\U0010ffff]")


def _marks(word: str) -> int:
    parts = set(word.replace("'", "-").split("-")) if "'" in word or "-" in word else {word}
    got = _STRONG * (not M.STRONG.heads.isdisjoint(parts)) | _BROAD * (not M.BROAD.heads.isdisjoint(parts)) | _BUT * ("but" in parts) | _HERE * ("there" in parts)
    bits = M._LEX.get(word, M._NONE)[3]
    got |= _OPENS * (bits & _CATS != 0 or word in ("e", "i"))  # "e.g." and "i.e." begin so
    return got | _SUB * (word in M.SUBORDINATORS) | _PHRASE * (word in M._BEGIN) | _SECOND * (word in _SECONDS)


class Words:
    """Words, numbered from 0, and by fact and word: compact and extended class, relation, bits, length, stem, marks."""

    def __init__(self):
        self.names, self.stems = pa.array([], pa.large_string()), {"": 0}
        self.table = np.zeros((7, 0), np.int64)

    def __len__(self) -> int:
        return len(self.names)

    def numbers(self, found: pa.LargeStringArray) -> np.ndarray:
        """The number of each of some different words; new ones are added."""
        got = pc.index_in(found, value_set=self.names)
        if got.null_count:
            new = found.filter(got.is_null())
            rows = []
            for word in new.to_pylist():
                compact, extended, rel, bits, size, stem = M.facts.__wrapped__(word)
                rows.append((compact, extended, rel, bits, size, self.stems.setdefault(stem, len(self.stems)), _marks(word)))
            got = pc.index_in(found, value_set=(names := pa.concat_arrays([self.names, new])))
            self.names, self.table = names, np.concatenate([self.table, np.array(rows, np.int64).T], axis=1)
        return got.to_numpy(zero_copy_only=False).astype(np.int64)


_known = Words()


def _grouped(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in the order of the keys, equal ones by place, and where each group of equal keys begins."""
    n = len(keys[0])
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    bits = [int(k.max()).bit_length() for k in keys]
    own = n.bit_length()
    if sum(bits) + own <= 63:
        packed = np.zeros(n, np.int64)
        for k, b in zip(keys, bits, strict=True):
            packed = packed << b | k
        packed = packed << own | np.arange(n)
        packed.sort()
        at, packed = packed & ((1 << own) - 1), packed >> own
        new = packed[1:] != packed[:-1]
    else:
        at = np.lexsort(keys[::-1])
        new = np.zeros(n - 1, bool)
        for k in keys:
            new |= k[at[1:]] != k[at[:-1]]
    return at, np.flatnonzero(np.concatenate([[True], new]))


def _ends(begins: np.ndarray, n: int) -> np.ndarray:
    return np.append(begins[1:], n) if len(begins) else begins


class _Batch:
    """Documents 0..d-1, their sentences and words in order."""

    def __init__(self, clean: list[str], words: Words, own: list[list[str]] | None = None):
        self.clean, self.words, self.d = clean, words, len(clean)
        own = [M.sentences(c) for c in clean] if own is None else own
        self.n_sent = np.array([len(s) for s in own], np.int64)
        self.sents = [s for x in own for s in x]
        self.units = np.frombuffer(_MARK.join(self.sents).lower().encode("utf-16-le", "surrogatepass"), np.uint16)
        self.breaks = np.flatnonzero(self.units == 0xFFFF)
        self._tokens()
        self.facts = words.table
        self.sent_doc = np.repeat(np.arange(self.d), self.n_sent)
        self.doc = self.sent_doc[self.sent] if len(self.w) else self.w
        self.n = self.by_doc(self.doc)
        self.bounds = np.concatenate([[0], np.cumsum(self.n)])
        self.pos = np.arange(len(self.w)) - self.bounds[self.doc]
        self.sent_bounds = np.concatenate([[0], np.cumsum(self.n_sent)])
        self.marks = self.facts[6][self.w]

    def _tokens(self) -> None:
        """The number and the sentence of each word: letters, and an apostrophe or hyphen between two of them."""
        u = self.units
        letter = (u >= 97) & (u <= 122)
        inner = np.flatnonzero((u == 39) | (u == 45))
        inner = inner[(inner > 0) & (inner < len(u) - 1)]
        inside = letter.copy()
        inside[inner[letter[inner - 1] & letter[inner + 1]]] = True
        edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
        begins, ends = edges[::2], edges[1::2]
        offsets = np.concatenate([[0], np.cumsum(ends - begins)])
        spelled = pa.LargeStringArray.from_buffers(len(begins), pa.py_buffer(offsets), pa.py_buffer(u[inside].astype(np.uint8))).dictionary_encode()
        self.w = self.words.numbers(spelled.dictionary)[spelled.indices.to_numpy()]
        self.sent = np.searchsorted(self.breaks, begins)

    def by_doc(self, doc: np.ndarray) -> np.ndarray:
        return np.bincount(doc, minlength=self.d)

    def sums(self, doc: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Sums of whole numbers by document; doc ascends."""
        run = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
        at = np.searchsorted(doc, np.arange(self.d + 1))
        return run[at[1:]] - run[at[:-1]]

    def groups(self) -> tuple[np.ndarray, ...]:
        """Places by document, word and place; where each different word of a document begins; its document, word and count."""
        if not hasattr(self, "_groups"):
            at, begins = _grouped(self.doc, self.w)
            first = at[begins]
            self._groups = at, begins, self.doc[first], self.w[first], np.diff(np.append(begins, len(at)))
        return self._groups

    def blank_words(self) -> np.ndarray:
        """White-space words of each sentence."""
        if not hasattr(self, "_blank"):
            begins = np.flatnonzero(np.diff(_INK[self.units].view(np.int8), prepend=np.int8(0)) == 1)
            self._blank = np.bincount(np.searchsorted(self.breaks, begins), minlength=len(self.sents))
        return self._blank

    def signed(self) -> np.ndarray:
        """Whether each sentence holds a colon or a dash."""
        units = self.units
        hit = (units == 0x3A) | (units == 0x2013) | (units == 0x2014)
        hit[:-1] |= (units[:-1] == 0x2D) & (units[1:] == 0x2D)
        out = np.zeros(len(self.sents), bool)
        out[np.searchsorted(self.breaks, np.flatnonzero(hit))] = True
        return out


def _bits(values: np.ndarray, bounds: np.ndarray) -> list[float]:
    """Sums of c * log2(c) of stretches of counts, exact but for the last rounding."""
    kept = np.flatnonzero(values > 1)
    own = values[kept]
    parts = _LOGS[np.minimum(own, len(_LOGS) - 1)]
    for k in np.flatnonzero(own >= len(_LOGS)).tolist():
        parts[k] = int(own[k]) * math.log2(int(own[k]))
    at, parts = np.searchsorted(kept, bounds), parts.tolist()
    return [math.fsum(parts[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def _where(ok: np.ndarray, got: dict) -> dict:
    """Columns with null where not ok."""
    return {k: (np.asarray(v), ~ok) for k, v in got.items()}


def _counts(b: _Batch) -> dict:
    at, begins, gd, gw, c = b.groups()
    compact, extended, _, bits, size = b.facts[:5]
    spread = lambda of: np.bincount(b.doc * 7 + of[b.w], minlength=b.d * 7).reshape(b.d, 7)
    k, e = spread(compact), spread(extended)
    some = np.flatnonzero(bits[b.w] & sum(M._HIT_BITS))
    own, doc = bits[b.w[some]], b.doc[some]
    first, last = at[begins], at[_ends(begins, len(at)) - 1] if len(at) else at
    p = b.pos[first]
    content = (size[gw] > 2) & (bits[gw] & M._STOP == 0)
    again = content & (b.sent[first] < b.sent[last])
    got = {
        "n": b.n, "types": b.by_doc(gd), "letters": b.sums(b.doc, size[b.w]), "hapax": b.by_doc(gd[c == 1]), "c2": b.sums(gd, c * c), "p1": b.sums(gd, p), "p2": b.sums(gd, p * p),
        "content": b.sums(gd, c * content), "content_types": b.by_doc(gd[content]), "repeated_types": b.by_doc(gd[again]),
    }
    got |= {f"k{i}": k[:, i] for i in range(1, 7)} | {f"e{i}": e[:, i] for i in range(1, 7)}
    got |= {name: b.by_doc(doc[own & x != 0]) for name, x in zip(M.HITS, M._HIT_BITS, strict=True)}
    return _where(b.n > 0, got)


def _lengths(b: _Batch) -> dict:
    n = b.blank_words()
    bins = np.searchsorted([5, 10, 15, 20, 30], n)
    held = np.bincount(b.sent_doc * 6 + bins, minlength=b.d * 6)
    return _where(b.n_sent > 0, {"len_m": b.n_sent, "len_s1": b.sums(b.sent_doc, n), "len_s2": b.sums(b.sent_doc, n * n), "sb_s": np.array(_bits(held, np.arange(b.d + 1) * 6))})


def _of_sentences(b: _Batch, mark: int) -> np.ndarray:
    out = np.zeros(len(b.sents), bool)
    out[b.sent[b.marks & mark != 0]] = True
    return out


def _cues(b: _Batch) -> dict:
    opens = np.zeros(len(b.sents), bool)
    if len(b.w):
        head = np.concatenate([[True], b.sent[1:] != b.sent[:-1]])
        opens[b.sent[head & (b.marks & _OPENS != 0)]] = True
    strong, broad, but, signed = _of_sentences(b, _STRONG), _of_sentences(b, _BROAD), _of_sentences(b, _BUT), b.signed()
    total = np.zeros((3, b.d), np.int64)
    asked = np.flatnonzero(opens | strong | broad | but | signed)
    n = b.blank_words()
    for k, d, begins, s_hit, b_hit, but_hit, mark in zip(asked.tolist(), b.sent_doc[asked].tolist(), opens[asked].tolist(), strong[asked].tolist(), (broad & (n >= M.LONG_PHRASE))[asked].tolist(), but[asked].tolist(), signed[asked].tolist(), strict=True):
        s = b.sents[k]
        if not s.isascii():
            got = M.cues([s])
            hit0, hit1, more = got["elaboration"], got["contrast"], got["markers"] - got["elaboration"] - got["contrast"]
        else:
            hit0, hit1, more = 0, 0, 0
            lower = s.lower()
            if begins:
                hit = M.opening(s, lower)
                hit0, hit1, more = hit[0], hit[1], sum(hit[2:])
            if not hit0 and (s_hit or b_hit or mark):
                x = M.scrubbed(s)
                hit0 = int(s_hit and M.STRONG.pattern.search(x) is not None or b_hit and M.BROAD.pattern.search(x) is not None and len(x.split()) >= M.LONG_PHRASE or mark and M.signed(x))
            if not hit1 and but_hit:
                hit1 = int(any(w not in M._TRIGGERS for w in M._BUT.findall(lower)))
        total[0, d] += hit0
        total[1, d] += hit1
        total[2, d] += hit0 + hit1 + more
    return _where(b.n_sent > 0, {"elaboration": total[0], "contrast": total[1], "markers": total[2]})


def _relations(b: _Batch) -> dict:
    rel, bits = b.facts[2][b.w], b.facts[3][b.w]
    m = len(b.sents)
    size = np.bincount(b.sent, minlength=m)
    some = np.flatnonzero((rel > 0) & ~((rel == 5) & (bits & M._BROAD != 0) & (size[b.sent] < M.LONG_PHRASE)))
    has = np.zeros((m, 10), bool)
    has[b.sent[some], rel[some]] = True
    dominant = np.zeros(m, np.int64)
    dominant[b.sent[some][::-1]] = rel[some][::-1]  # the first one is set last
    for k in np.flatnonzero(b.signed() & ~has[:, 5]).tolist():
        if M.xglossed(b.sents[k]):
            has[k, 5] = True
            dominant[k] = dominant[k] or 5
    total = np.stack([np.bincount(b.sent_doc[has[:, r]], minlength=b.d) for r in range(10)])
    every = total.sum(axis=0)
    before = np.concatenate([[0], dominant[:-1]]) if m else dominant
    before[b.sent_bounds[:-1][b.n_sent > 0]] = 0
    both = (dominant > 0) & (before > 0)
    at = np.arange(m)
    begins = np.maximum.accumulate(np.where(both & (dominant == before), 0, at)) if m else at
    run = np.where(dominant > 0, at - begins + 1, 0)
    deep = np.zeros(b.d, np.int64)
    np.maximum.at(deep, b.sent_doc, run)
    got = _where(every > 0, {**{f"r{r}": total[r] for r in range(1, 10)}, "rel_total": every}) | _where(b.n_sent > 0, {"pairs": b.by_doc(b.sent_doc[both]), "switches": b.by_doc(b.sent_doc[both & (dominant != before)])})
    return got | _where(deep > 0, {"deep": deep})


def _stems(b: _Batch) -> dict:
    stem = b.facts[5][b.w]
    some = np.flatnonzero(stem)
    doc, sent = b.doc[some], b.sent[some]
    at, begins = _grouped(doc, stem[some])
    gd, sent = doc[at[begins]], sent[at]
    new = np.concatenate([[True], sent[1:] != sent[:-1]]) if len(at) else np.zeros(0, bool)
    new[begins] = True
    m = np.diff(np.concatenate([[0], np.cumsum(new)])[np.append(begins, len(at))])
    span = (sent[_ends(begins, len(at)) - 1] - sent[begins]) if len(at) else begins
    chain = m >= 3
    n = b.by_doc(doc)
    return _where(n > 0, {"st_n": n, "stems": b.by_doc(gd), "again": b.by_doc(gd[m >= 2]), "chains": b.by_doc(gd[chain]), "span": b.sums(gd, span * chain)})


def _spread(b: _Batch) -> dict:
    ok = b.n >= M.ENVELOPE
    at, begins, gd, gw, c = b.groups()
    group = np.empty(len(at), np.int64)
    group[at] = np.repeat(np.arange(len(begins)), c)
    last = np.full(len(at), -1, np.int64)  # the place of the word before
    again = np.ones(len(at), bool)
    again[begins] = False
    later = np.flatnonzero(again)
    last[at[later]] = b.pos[at[later - 1]]
    low, high = np.maximum(np.maximum(b.pos - M.WINDOW + 1, last + 1), 0), np.minimum(b.pos, b.n[b.doc] - M.WINDOW)
    window = b.sums(b.doc, np.maximum(high - low + 1, 0))
    pair = np.flatnonzero(b.doc[1:] == b.doc[:-1]) if len(at) else at
    where, starts = _grouped(group[pair], group[pair + 1])
    many = np.diff(np.append(starts, len(where)))
    pd = b.doc[pair[where[starts]]] if len(where) else where
    bigrams = _bits(many, np.searchsorted(pd, np.arange(b.d + 1)))
    second = pair[where[starts[many > 1] + 1]] if len(where) else where
    second.sort()
    cut = np.searchsorted(b.doc[second], np.arange(b.d + 1)) if len(second) else np.zeros(b.d + 1, np.int64)
    twice = np.diff(cut)
    half = np.zeros(b.d, np.int64)
    half[twice > 0] = b.pos[second[(cut[:-1] + (twice + 1) // 2 - 1)[twice > 0]]] if len(second) else 0
    top = np.flatnonzero((c >= 3) & (b.facts[4][gw] >= 3) & ok[gd])
    top = top[np.lexsort((at[begins[top]], -c[top], gd[top]))]
    rank = np.arange(len(top)) - np.searchsorted(gd[top], gd[top])
    top = top[rank < M.TOP]
    bursts: list[list[float]] = [[] for _ in range(b.d)]
    gaps, owner = c[top] - 1, np.repeat(np.arange(len(top)), c[top] - 1)
    cuts = np.concatenate([[0], np.cumsum(gaps)])
    begin = begins[top][owner] + np.arange(len(owner)) - cuts[owner]
    places = b.pos[at]
    mu = (places[begins[top] + gaps] - places[begins[top]]) / gaps
    off = ((places[begin + 1] - places[begin] - mu[owner]) ** 2).tolist()
    for d, x, y, m in zip(gd[top].tolist(), cuts[:-1].tolist(), cuts[1:].tolist(), mu.tolist(), strict=True):
        sigma = math.sqrt(math.fsum(off[x:y]) / (y - x))
        bursts[d].append((sigma - m) / (sigma + m))
    burst = np.array([math.fsum(x) / len(x) if x else 0.0 for x in bursts])
    return _where(ok, {"mattr_total": window, "bg_s": np.array(bigrams)}) | _where(ok & (twice > 0), {"half_pos": half}) | _where(np.array([len(x) > 0 for x in bursts], bool), {"burst": burst})


def _letters(b: _Batch) -> dict:
    plain = [i for i, c in enumerate(b.clean) if c.isascii() or not _UNEVEN.search(c)]
    halves = [x for i in plain for x in (b.clean[i][: len(b.clean[i]) // 2], b.clean[i][len(b.clean[i]) // 2 :])]
    code = _LOWER[np.frombuffer("".join(halves).encode("utf-16-le", "surrogatepass"), np.uint16)]
    half = np.repeat(np.arange(len(halves)), [len(x) for x in halves])[code > 0]
    code = code[code > 0].astype(np.int64)
    some = (code >= 97) & (code < 123)
    held = np.bincount(half[some] * 26 + code[some] - 97, minlength=len(halves) * 26)
    there = np.flatnonzero(held)
    at, begins = _grouped(half[~some], code[~some])
    first = at[begins]
    own = np.concatenate([there // 26, half[~some][first]]), np.concatenate([there % 26, code[~some][first]]), np.concatenate([held[there], np.diff(np.append(begins, len(at)))])
    xh, xc, xn = (x[np.argsort(own[0], kind="stable")] for x in own)
    of_half = _bits(xn, np.searchsorted(xh, np.arange(len(halves) + 1)))
    size = np.bincount(xh, xn, minlength=len(halves)).astype(np.int64).tolist()
    at, begins = _grouped(xh // 2, xc)
    both = _bits(np.add.reduceat(xn[at], begins) if len(at) else at, np.searchsorted(xh[at[begins]] // 2, np.arange(len(plain) + 1)))
    entropy = [math.log2(n) - x / n if n else 0.0 for x, n in zip(of_half, size, strict=True)]
    out = np.zeros((3, b.d))
    for j, i in enumerate(plain):
        out[:, i] = size[2 * j] + size[2 * j + 1], both[j], abs(entropy[2 * j] - entropy[2 * j + 1])
    for i in set(range(b.d)).difference(plain):
        out[:, i] = [x or 0.0 for x in M.letters(b.clean[i]).values()]
    return _where(out[0] > 0, {"ch_n": out[0].astype(np.int64), "ch_s": out[1], "drift": out[2]})


def _subordination(b: _Batch) -> dict:
    hits = b.by_doc(b.doc[b.marks & _SUB != 0])
    two = (b.marks[:-1] & _PHRASE != 0) & (b.marks[1:] & _SECOND != 0) & (b.sent[:-1] == b.sent[1:])
    for k in np.unique(b.sent[:-1][two]).tolist():  # a phrase may use up single words
        low, high = np.searchsorted(b.sent, [k, k + 1])
        own = b.words.names.take(pa.array(b.w[low:high])).to_pylist()
        hits[b.sent_doc[k]] += M.subordination([own])["sub_hits"] - int((b.marks[low:high] & _SUB != 0).sum())
    return _where(np.ones(b.d, bool), {"sub_hits": hits})


def _phrases(b: _Batch) -> dict:
    got = [phrase_rate(c) for c in b.clean]
    return _where(np.array([x is not None for x in got], bool), {"lz": np.array([x or 0.0 for x in got])})


_PARTS = {"sub": _subordination, "lz": _phrases, "counts": _counts, "len": _lengths, "cue": _cues, "rel": _relations, "stems": _stems, "spread": _spread, "letters": _letters}
_BASE = "n_words n_sent n_chars semicolons commas quotes questions exclaims has_end blank_words open_fence odd_quotes n_exist n_cop".split()


def _base(b: _Batch, raw: list[str]) -> dict:
    some = set(b.doc[b.marks & _HERE != 0].tolist())
    verbs = [_THERE.findall(c) if i in some else () for i, c in enumerate(b.clean)]
    last = np.array([ord(s[-1]) for s in b.sents], np.int64)
    quotes = lambda c: sum(map(c.count, T.QUOTES)) if not c.isascii() else c.count('"') + c.count("'")
    got = {
        "n_words": b.n, "n_sent": b.n_sent, "n_chars": [len(c) for c in b.clean], "semicolons": [c.count(";") for c in b.clean], "commas": [c.count(",") for c in b.clean], "quotes": [quotes(c) for c in b.clean],
        "questions": b.by_doc(b.sent_doc[last == 63]), "exclaims": b.by_doc(b.sent_doc[last == 33]), "has_end": np.array(["." in c or "!" in c or "?" in c for c in b.clean], bool), "blank_words": b.sums(b.sent_doc, b.blank_words()),
        "open_fence": np.array([M.open_fence(r) for r in raw], bool), "odd_quotes": np.array([r.count('"') % 2 == 1 or r.count("“") != r.count("”") for r in raw], bool), "n_exist": [len(v) for v in verbs], "n_cop": [sum(x.lower() in _IS for x in v) for v in verbs],
    }
    return _where(np.ones(b.d, bool), {k: np.asarray(v, None if isinstance(v, np.ndarray) else np.int64) for k, v in got.items()})


def _chunks(texts: list[str]):
    begin = size = 0
    for k, t in enumerate(texts):
        if size and size + len(t) > CHARACTERS:
            yield begin, k
            begin, size = k, 0
        size += len(t)
    if begin < len(texts):
        yield begin, len(texts)


def _current() -> Words:
    """The words known so far; a table grown too large is begun anew."""
    global _known
    if len(_known) > KNOWN:
        _known = Words()
    return _known


def _read(texts: list[str | None]):
    """Pieces of a batch: the place of the first text, canonical and clean texts, and which are odd, those being blank among the clean ones."""
    raw = [M.canonical(t) for t in texts]
    for low, high in _chunks(raw):
        clean = [M.unfenced(r) for r in raw[low:high]]
        odd = [i for i, c in enumerate(clean) if not c.isascii() and _ODD.search(c)]
        for i in odd:
            clean[i] = ""
        yield low, raw[low:high], clean, odd


def measure_all(texts: list[str | None], parts: frozenset[str]) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """By column, the values of measure() for each text and where they are null."""
    found: list[dict] = []
    for _, own, clean, odd in _read(texts):
        b = _Batch(clean, _current())
        got = _base(b, own)
        for p in parts:
            got |= _PARTS[p](b)
        for i in odd:
            row = M.measure(own[i], parts)
            for name, (values, null) in got.items():
                null[i] = row.get(name) is None
                values[i] = 0 if null[i] else row[name]
        found.append(got)
    if not found:
        return {}
    return {c: tuple(np.concatenate([f[c][k] for f in found]) for k in (0, 1)) for c in found[0]}


def _curves(cut: list[list[tuple]]) -> list[list[tuple]]:
    """Rows of slices from (text, lengths of sentences, white-space words, level and place if any) of each slice of each text."""
    texts = [x[0] for own in cut for x in own]
    of = np.repeat(np.arange(len(cut)), [len(own) for own in cut])
    b = _Batch(texts, _current(), [[t] for t in texts])
    bits, size = b.facts[3], b.facts[4]
    _, _, gs, gw, _ = b.groups()
    kept = (size[gw] > 2) & (bits[gw] & M._STOP == 0)
    gs, gw = gs[kept], gw[kept]
    at, begins = _grouped(of[gs], gw)
    hits = [b.by_doc(b.doc[bits[b.w] & x != 0]).tolist() for x in (M._MODAL, M._NEG)]
    rows = zip(b.n.tolist(), b.by_doc(gs).tolist(), b.by_doc(gs[at[begins]]).tolist(), *hits, strict=True)
    out = []
    for own in cut:
        got, first = [], 0
        for k, (_, lens, size, *more) in enumerate(own):
            t, kinds, new, modal, neg = next(rows)
            m = len(lens)
            variance = 0.0 if m < 2 else (m * sum(x * x for x in lens) - sum(lens) ** 2) / (m * m)
            novelty = None if k == 0 else new / kinds if kinds else 0.0
            got.append((k, len(own), size, first, first + size - 1, novelty, variance, modal * 100.0 / t if t else 0.0, neg * 100.0 / t if t else 0.0, *more))
            first += size
        out.append(got)
    return out


def _equal(clean: str) -> list[tuple]:
    parts = clean.split()
    n = len(parts)
    if not n:
        return []
    slices = 1 if n < M.SLICE else n // M.SLICE
    chunk = n // slices
    ends = [k + 1 for k, w in enumerate(parts[:-1]) if w[-1] in ".!?" and "A" <= parts[k + 1][0] <= "Z" and w.rstrip(".").lower() not in M._ABBREVIATIONS]
    out, at = [], 0
    for k in range(slices):
        low, high = k * chunk, n if k == slices - 1 else (k + 1) * chunk
        lens, before = [], low
        while at < len(ends) and ends[at] < high:
            if ends[at] > low:
                lens.append(ends[at] - before)
                before = ends[at]
            at += 1
        out.append((" ".join(parts[low:high]), [*lens, high - before], high - low))
    return out


def _structural(clean: str) -> list[tuple]:
    level, cuts = structural_slices(clean)
    own = [clean[low:high] for low, high in cuts]
    return [(x, [len(s.split()) for s in M.split([x])], len(x.split()), level, low, high) for x, (low, high) in zip(own, cuts, strict=True)]


def _sliced(texts: list[str | None], cut, one) -> list[list[tuple]]:
    out = []
    for _, own, clean, odd in _read(texts):
        got = _curves([cut(c) for c in clean])
        for i in odd:
            got[i] = one(own[i])
        out += got
    return out


def curves_all(texts: list[str | None]) -> list[list[tuple]]:
    """measure.curves() of each text."""
    return _sliced(texts, _equal, M.curves)


def elegant_all(texts: list[str | None]) -> list[list[tuple]]:
    """measure.elegant() of each text."""
    return _sliced(texts, _structural, M.elegant)


def sentence_hits(texts: list[str | None], flag: int):
    """Of each text: clean, and by sentence its words and those of a list."""
    for _, own, clean, odd in _read(texts):
        b = _Batch(clean, _current())
        n = np.bincount(b.sent, minlength=len(b.sents))
        m = np.bincount(b.sent[b.facts[3][b.w] & flag != 0], minlength=len(b.sents))
        for i, (low, high) in enumerate(zip(b.sent_bounds[:-1].tolist(), b.sent_bounds[1:].tolist(), strict=True)):
            if i in odd:
                c = M.unfenced(own[i])
                toks = [M.tokens(s) for s in M.sentences(c)]
                yield c, np.array([len(x) for x in toks], np.int64), np.array([sum(M.facts(w)[3] & flag != 0 for w in x) for x in toks], np.int64)
            else:
                yield clean[i], n[low:high], m[low:high]


def top_all(texts: list[str | None], most: int, least: int) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """The most frequent words of at least so many letters, ties by first place: text, word, count, place from 1."""
    owner, words, counts, places = [], [], [], []
    for begin, own, clean, odd in _read(texts):
        b = _Batch(clean, _current())
        at, begins, gd, gw, c = b.groups()
        top = np.flatnonzero(b.facts[4][gw] >= least)
        top = top[np.lexsort((at[begins[top]], -c[top], gd[top]))]
        rank = np.arange(len(top)) - np.searchsorted(gd[top], gd[top])
        top, rank = top[rank < most], rank[rank < most]
        owner.append(gd[top] + begin)
        words.append(b.words.names.take(pa.array(gw[top])))
        counts.append(c[top])
        places.append(rank + 1)
        for i in odd:
            many = Counter(w for s in M.sentences(M.unfenced(own[i])) for w in M.tokens(s) if len(w) >= least).most_common(most)
            owner.append(np.full(len(many), begin + i))
            words.append(pa.array([w for w, _ in many], pa.large_string()))
            counts.append(np.array([n for _, n in many], np.int64))
            places.append(np.arange(1, len(many) + 1))
    if not owner:
        return np.zeros(0, np.int64), pa.array([], pa.large_string()), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(owner), pa.concat_arrays(words), np.concatenate(counts), np.concatenate(places)
