"""What a document's features are computed from, counted in one pass over its text.

measure() gives one flat row of counts for a text and curves() the rows of its
equal-word slices.  Both run inside one Arrow function over the rows of a table
(operators/wide.py), so measuring shuffles nothing, and every feature is an
expression over the row.  The rules are those of functions/text.py.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from functools import lru_cache

from . import text as T
from .kernels import phrase_rate, structural_slices
from .lexicon import bit, rows, words

_BOM = "\ufeff"
_TRAILING, _MANY = re.compile(r"(?m)[ \t]+$"), re.compile(r"\n{3,}")
_FRONT = re.compile(r"(?s)\A---[^\S\n]*\n.*?\n---[^\S\n]*(?:\n|\Z)")
_FENCE = re.compile(r"\s*(```|~~~)")
_PARAGRAPH = re.compile(r"\n\s*\n")
_END = re.compile(r"([.!?])\s+(?=[A-Z])")
_SHORT = re.compile(r"(?:" + "|".join(re.escape(a) for a in T.ABBREVIATIONS) + r")\.{1,9}", re.I)
_LONGEST = max(map(len, T.ABBREVIATIONS)) + 9
_WORD = re.compile(T.WORD)
_THERE, _COPULA = (re.compile(rf"\bthere\s+(?:{verbs})\b", re.I | re.A) for verbs in ("is|are|was|were|exists?|existed", "is|are|was|were"))
_LEX = {r[0]: r[1:5] for r in rows()}
_NONE = (0, 0, 0, 0)
HITS = "pron modal neg sub1 xmodal hedge boost xpron demon defart addc advc cauc temc".split()
_HIT_BITS = [bit(x) for x in HITS]
_STOP, _BROAD, _INIT, _MODAL, _NEG = (bit(x) for x in ("stop", "broad", "init_only", "modal", "neg"))
CATS = ["i_elab", "i_contrast", "i_cause", "i_result", "i_cond", "i_joint"]
_CAT_BITS = [bit(x) for x in CATS]
_SUFFIXES = "ingly ation ions ing ies ied ed es s ly".split()
LONG_PHRASE = 8
ENVELOPE = 150
TOP = 20
WINDOW = 100
SLICE = 150


def canonical(text: str | None) -> str:
    t = (text or "").removeprefix(_BOM)
    if "\r" in t:
        t = t.replace("\r\n", "\n").replace("\r", "\n")
    t = _TRAILING.sub("", t)
    return _MANY.sub("\n\n", t) if "\n\n\n" in t else t


def unfenced(text: str) -> str:
    """Of canonical text: plain apostrophes, no front matter, and no closed fenced blocks."""
    text = text.replace("’", "'")
    if text.startswith("---"):
        text = _FRONT.sub("", text, count=1)
    if "```" not in text and "~~~" not in text:
        return text
    lines, mark, at = text.split("\n"), "", 0
    out = []
    for line in lines:
        start = m[1] if (m := _FENCE.match(line)) else ""
        if mark:
            out.append("")
            mark = "" if start == mark else mark
        elif start:
            mark, at = start, len(out)
            out.append("")
        else:
            out.append(line)
    return "\n".join(out[:at] + lines[at:] if mark else out)


def open_fence(text: str) -> bool:
    """Whether a fence of canonical text is never closed."""
    mark = ""
    for line in text.split("\n") if "```" in text or "~~~" in text else ():
        start = m[1] if (m := _FENCE.match(line)) else ""
        mark = ("" if start == mark else mark) if mark else start
    return mark != ""


def sentences(text: str) -> list[str]:
    return split(_PARAGRAPH.split(text) if "\n" in text else [text])


def split(parts: list[str]) -> list[str]:
    """The sentences of each part in order."""
    found = []
    for part in parts:
        pieces = _END.sub("\\1\uffff", part.strip()).split("\uffff")
        if len(pieces) == 1:
            if s := pieces[0].strip():
                found.append(s)
            continue
        joined = ""
        for s in pieces[:-1]:
            if s[-1:] == "." and len(last := s.rsplit(None, 1)[-1]) <= _LONGEST and _SHORT.fullmatch(last):
                joined += s + " "
                continue
            if s := (joined + s).strip():
                found.append(s)
            joined = ""
        if s := (joined + pieces[-1]).strip():
            found.append(s)
    return found


def tokens(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


def kind(word: str, cls: int) -> int:
    """The compact class of a word: lists first, then its ending unless a deny list holds it."""
    if cls:
        return cls if cls < 7 else 0
    return 6 if word.endswith("ing") and len(word) > 5 or word.endswith("ed") and len(word) > 4 else 0


def stem(word: str) -> str:
    if len(word) >= 5:
        for s in _SUFFIXES:
            if word.endswith(s) and len(word) >= len(s) + 3:
                return word[: -len(s)]
    return word


@lru_cache(maxsize=50_000)
def facts(word: str) -> tuple:
    """(compact class, extended class, relation, bits, length, stem or "" if it isn't a content word of the wide view)."""
    cls, ext, rel, bits = _LEX.get(word, _NONE)
    return kind(word, cls), ext, rel, bits, len(word), stem(word) if len(word) >= 3 and not bits & _STOP else ""


def _bits(counts: Counter) -> float:
    """Sum of c * log2(c), in a fixed order."""
    return math.fsum(c * math.log2(c) for c in counts.values() if c > 1)


def counts(sents: list[list[str]]) -> dict:
    """Words by class and list; null as a whole without words."""
    first: dict[str, list[int]] = {}
    pos = 0
    for k, own in enumerate(sents):
        for w in own:
            if (f := first.get(w)) is None:
                first[w] = [1, pos, k, k]
            else:
                f[0] += 1
                f[3] = k
            pos += 1
    if not pos:
        return {}
    k, e, hits = [0] * 7, [0] * 7, [0] * len(HITS)
    letters = hapax = c2 = p1 = p2 = content = kinds = again = 0
    for w, (c, p, s0, s1) in first.items():
        compact, extended, _, bits, size, _ = facts(w)
        k[compact] += c
        e[extended] += c
        letters += c * size
        hapax += c == 1
        c2 += c * c
        p1 += p
        p2 += p * p
        if bits:
            for i, b in enumerate(_HIT_BITS):
                if bits & b:
                    hits[i] += c
        if size > 2 and not bits & _STOP:
            content += c
            kinds += 1
            again += s0 < s1
    got = {"n": pos, "types": len(first), "letters": letters, "hapax": hapax, "c2": c2, "p1": p1, "p2": p2, "content": content, "content_types": kinds, "repeated_types": again}
    got |= {f"k{i}": k[i] for i in range(1, 7)} | {f"e{i}": e[i] for i in range(1, 7)}
    return got | dict(zip(HITS, hits, strict=True))


def lengths(sents: list[str]) -> dict:
    """Sentences by white-space words: number, sum, sum of squares, and the entropy's parts over six bins."""
    if not sents:
        return {}
    n = [len(s.split()) for s in sents]
    bins = Counter(1 if x <= 5 else 2 if x <= 10 else 3 if x <= 15 else 4 if x <= 20 else 5 if x <= 30 else 6 for x in n)
    return {"len_m": len(n), "len_s1": sum(n), "len_s2": sum(x * x for x in n), "sb_s": _bits(bins)}


_TRIGGERS = frozenset(["nothing", "anything", "all", "everything", "none"])
_BUT = re.compile(r"(\w+)\W+but(?:\W|$)")
_BARE, _MARKER, _FIRST = re.compile(r"[ ,;:—-]+"), re.compile(r"([^ ,]+)[ ,]"), re.compile(r"\S*", re.A)
_OFF = re.compile(r"^\s*#|\||^\s*(?:[-*+]|\d+\.)\s+|^[\s\-*_=]*$", re.A)
_CODE = re.compile(r"`[^`\n]*`")
_DASH = re.compile(r"[a-z]\w*[^\n]{0,80}?\s+(?:[–—]|--)\s+[A-Za-z]", re.A)
_COLON = re.compile(r"[a-z]{2,}:\s+[a-z]{3,}", re.A)
_XDASH = re.compile(r"[A-Za-z][^\n]{1,120}?\s+(?:[–—]|--)\s+[A-Za-z]", re.A)
_XCOLON = re.compile(r"[A-Za-z]\s*:\s+[a-z][a-z]+", re.A)


class _Cues:
    """Whether a text holds a cue as a whole word; the pattern is tried only if a cue's first word occurs."""

    def __init__(self, found: list[str]):
        plain = "|".join(w for w in found if w[-1] != ".")
        dotted = "|".join(w.replace(".", r"\.") for w in found if w[-1] == ".")
        self.pattern = re.compile(rf"(?i)(?:^|\W)(?:{plain})(?:$|\W)" + (rf"|(?:^|\W)(?:{dotted})\w" if dotted else ""))
        self.heads = frozenset(re.match(r"\w+", w)[0] for w in found)

    def inside(self, text: str, lower: set[str]) -> bool:
        return not self.heads.isdisjoint(lower) and self.pattern.search(text) is not None


_BROAD_CUES = words("rst_elaboration_broad")
STRONG, BROAD = _Cues([w for w in words("rst_elaboration") if w not in _BROAD_CUES]), _Cues(_BROAD_CUES)
_WORDS = re.compile(r"\w+")


def scrubbed(sentence: str) -> str:
    """A sentence without the lines and code that hold no prose."""
    if "\n" in sentence or "|" in sentence or not sentence[0].isalpha():
        sentence = "\n".join(x for x in sentence.split("\n") if not _OFF.search(x))
    return _CODE.sub(" ", sentence) if "`" in sentence else sentence


def signed(sentence: str) -> bool:
    """Whether a dash or a colon glosses in a scrubbed sentence."""
    dash = "–" in sentence or "—" in sentence or "--" in sentence
    return bool(dash and _DASH.search(sentence) or ":" in sentence and _COLON.search(sentence))


def glossed(sentence: str, lower: set[str]) -> bool:
    sentence = scrubbed(sentence)
    return bool(STRONG.inside(sentence, lower) or BROAD.inside(sentence, lower) and len(sentence.split()) >= LONG_PHRASE or signed(sentence))


def xglossed(sentence: str) -> bool:
    dash = "–" in sentence or "—" in sentence or "--" in sentence
    return bool(dash and _XDASH.search(sentence) or ":" in sentence and _XCOLON.search(sentence))


def opening(s: str, lower: str) -> list[int]:
    """The categories of the marker that opens a sentence."""
    head = lower[m.end() :] if (m := _BARE.match(lower)) else lower
    marker = m[1] if (m := _MARKER.match(head)) else ""
    bits = _LEX.get(marker, _NONE)[3]
    hit = [0] * 6
    if bits and (not bits & _INIT or _FIRST.match(head)[0].rstrip(",.;:!?") == marker):
        hit = [int(bits & b != 0) for b in _CAT_BITS]
        if hit[0] and bits & _BROAD and len(s.split()) < LONG_PHRASE:
            hit[0] = 0
    return hit


def cues(sents: list[str]) -> dict:
    """Compact discourse cues by sentence: elaboration, contrast and all markers."""
    if not sents:
        return {}
    elaboration = contrast = markers = 0
    for s in sents:
        lower = s.lower()
        hit = opening(s, lower)
        hit[0] = int(hit[0] or glossed(s, set(_WORDS.findall(lower))))
        hit[1] = int(hit[1] or "but" in lower and any(w not in _TRIGGERS for w in _BUT.findall(lower)))
        elaboration += hit[0]
        contrast += hit[1]
        markers += sum(hit)
    return {"elaboration": elaboration, "contrast": contrast, "markers": markers}


def relations(sents: list[str], toks: list[list[str]]) -> dict:
    """Extended discourse relations by sentence; the first one in a sentence is its dominant one."""
    if not sents:
        return {}
    total, dominant = [0] * 10, []
    for s, own in zip(sents, toks, strict=True):
        seen = []
        for w in own:
            _, _, rel, bits, _, _ = facts(w)
            if rel and rel not in seen and not (rel == 5 and bits & _BROAD and len(own) < LONG_PHRASE):
                seen.append(rel)
        if 5 not in seen and xglossed(s):
            seen.append(5)
        for rel in seen:
            total[rel] += 1
        dominant.append(seen[0] if seen else 0)
    deep = run = pairs = switches = 0
    for k, rel in enumerate(dominant):
        before = dominant[k - 1] if k else 0
        run = run + 1 if rel and rel == before else int(rel > 0)
        deep = max(deep, run)
        pairs += rel > 0 and before > 0
        switches += rel > 0 and before > 0 and rel != before
    some = sum(total)
    got = {f"r{k}": total[k] if some else None for k in range(1, 10)}
    return got | {"rel_total": some or None, "pairs": pairs, "switches": switches, "deep": deep or None}


def stems(toks: list[list[str]]) -> dict:
    """Stems of content words and the sentences that they span."""
    at: dict[str, list[int]] = {}
    n = 0
    for k, own in enumerate(toks):
        for w in own:
            if s := facts(w)[5]:
                n += 1
                if (x := at.get(s)) is None:
                    at[s] = [1, k, k]
                elif x[2] != k:
                    x[0] += 1
                    x[2] = k
    if not n:
        return {}
    chains = [(lo, hi) for m, lo, hi in at.values() if m >= 3]
    return {"st_n": n, "stems": len(at), "again": sum(m >= 2 for m, _, _ in at.values()), "chains": len(chains), "span": sum(hi - lo for lo, hi in chains)}


def spread(flat: list[str]) -> dict:
    """Moving-window types, bigrams, their half-life and the burstiness of frequent words, of texts in the envelope."""
    n = len(flat)
    if n < ENVELOPE:
        return {}
    last: dict[str, int] = {}
    window = 0
    for pos, w in enumerate(flat):
        low, high = max(pos - WINDOW + 1, last.get(w, -1) + 1, 0), min(pos, n - WINDOW)
        if high >= low:
            window += high - low + 1
        last[w] = pos
    pairs: dict[tuple[str, str], int] = defaultdict(int)
    second = []
    for pos, pair in enumerate(zip(flat, flat[1:])):
        pairs[pair] += 1
        if pairs[pair] == 2:
            second.append(pos)
    many = Counter(w for w in flat if len(w) >= 3)
    top = [w for w, c in many.most_common(TOP) if c >= 3]  # ties by first place, as counted
    places: dict[str, list[int]] = {w: [] for w in top}
    for pos, w in enumerate(flat):
        if w in places:
            places[w].append(pos)
    bursts = []
    for at in places.values():
        gaps = [b - a for a, b in zip(at, at[1:])]
        mu = sum(gaps) / len(gaps)
        sigma = math.sqrt(math.fsum((g - mu) ** 2 for g in gaps) / len(gaps))
        bursts.append((sigma - mu) / (sigma + mu))
    return {"mattr_total": window, "bg_s": _bits(pairs), "half_pos": second[(len(second) + 1) // 2 - 1] if second else None, "burst": math.fsum(bursts) / len(bursts) if bursts else None}


def letters(text: str) -> dict:
    """The parts of the entropy of letters, of the whole and of both halves."""
    mid = len(text) // 2
    halves = [Counter({c: n for c, n in Counter(x.lower()).items() if c.isalpha()}) for x in (text[:mid], text[mid:])]
    size = [sum(h.values()) for h in halves]
    entropy = [math.log2(n) - _bits(h) / n if n else 0.0 for h, n in zip(halves, size, strict=True)]
    both = halves[0] + halves[1]
    return {"ch_n": sum(size) or None, "ch_s": _bits(both) if sum(size) else None, "drift": abs(entropy[0] - entropy[1]) if sum(size) else None}


#: Subordinating phrases, those of more words first, and single words.
PHRASES = sorted((tuple(p.split()) for p in ("even though", "as long as", "as soon as", "so that", "in order that", "provided that", "given that")), key=lambda p: (-len(p), p))
SUBORDINATORS = frozenset("although though because since unless until when whenever where wherever while whereas before after if once whether".split())
_BEGIN = {p[0] for p in PHRASES}


def subordination(toks: list[list[str]]) -> dict:
    """Subordinating phrases, which use up their words, and single words among the others."""
    hits = 0
    for own in toks:
        k = 0
        while k < len(own):
            w = own[k]
            size = next((len(p) for p in PHRASES if tuple(own[k : k + len(p)]) == p), 0) if w in _BEGIN else 0
            hits += size > 0 or w in SUBORDINATORS
            k += size or 1
    return {"sub_hits": hits}


def phrases(text: str) -> dict:
    return {"lz": phrase_rate(text)}


PARTS = {"sub": subordination, "lz": phrases, "counts": counts, "len": lengths, "cue": cues, "rel": relations, "stems": stems, "spread": spread, "letters": letters}


def measure(text: str | None, parts: frozenset[str]) -> dict:
    raw = canonical(text)
    clean = unfenced(raw)
    sents = sentences(clean)
    toks = [tokens(s) for s in sents]
    n = sum(map(len, toks))
    got = {
        "n_words": n, "n_sent": len(sents), "n_chars": len(clean), "semicolons": clean.count(";"), "commas": clean.count(","), "quotes": sum(map(clean.count, T.QUOTES)),
        "questions": sum(s.endswith("?") for s in sents), "exclaims": sum(s.endswith("!") for s in sents), "has_end": "." in clean or "!" in clean or "?" in clean, "blank_words": len(clean.split()),
        "open_fence": open_fence(raw), "odd_quotes": raw.count('"') % 2 == 1 or raw.count("“") != raw.count("”"), "n_exist": 0, "n_cop": 0,
    }
    if "here" in clean or "HERE" in clean:
        got["n_exist"], got["n_cop"] = len(_THERE.findall(clean)), len(_COPULA.findall(clean))
    flat = [w for own in toks for w in own] if "spread" in parts else []
    given = {"counts": (toks,), "len": (sents,), "cue": (sents,), "rel": (sents, toks), "stems": (toks,), "spread": (flat,), "letters": (clean,), "sub": (toks,), "lz": (clean,)}
    for p in parts:
        got |= PARTS[p](*given[p])
    return got


_ABBREVIATIONS = frozenset(T.ABBREVIATIONS)


def curves(text: str | None) -> list[tuple]:
    """(slice, n_slices, words, first, last, novelty, variance, modal, negation) of equal slices of white-space words."""
    parts = unfenced(canonical(text)).split()
    n = len(parts)
    if not n:
        return []
    slices = 1 if n < SLICE else n // SLICE
    chunk = n // slices
    out, known = [], set()
    for k in range(slices):
        low, high = k * chunk, n if k == slices - 1 else (k + 1) * chunk
        own = parts[low:high]
        lens, size = [], 1
        for before, w in zip(own, own[1:]):
            if before[-1] in ".!?" and "A" <= w[0] <= "Z" and before.rstrip(".").lower() not in _ABBREVIATIONS:
                lens.append(size)
                size = 0
            size += 1
        lens.append(size)
        m = len(lens)
        variance = 0.0 if m < 2 else (m * sum(x * x for x in lens) - sum(lens) ** 2) / (m * m)
        words_here = tokens(" ".join(own))
        modal = neg = 0
        kinds = set()
        for w in words_here:
            bits, size = facts(w)[3:5]
            modal += bits & _MODAL != 0
            neg += bits & _NEG != 0
            if size > 2 and not bits & _STOP:
                kinds.add(w)
        t = len(words_here)
        novelty = None if k == 0 else len(kinds - known) / len(kinds) if kinds else 0.0
        known |= kinds
        out.append((k, slices, len(own), low, high - 1, novelty, variance, modal * 100.0 / t if t else 0.0, neg * 100.0 / t if t else 0.0))
    return out


def elegant(text: str | None) -> list[tuple]:
    """The row of curves() for each structural slice, with its level and place in the cleaned text; a blank text is one slice."""
    clean = unfenced(canonical(text))
    level, cuts = structural_slices(clean)
    out, known, first = [], set(), 0
    for k, (low, high) in enumerate(cuts):
        own = clean[low:high]
        lens = [len(x.split()) for x in split([own])]
        m, size = len(lens), len(own.split())
        variance = 0.0 if m < 2 else (m * sum(x * x for x in lens) - sum(lens) ** 2) / (m * m)
        words_here = tokens(own)
        kinds = {w for w in words_here if len(w) > 2 and not facts(w)[3] & _STOP}
        hits = [sum(facts(w)[3] & b != 0 for w in words_here) * 100.0 / len(words_here) if words_here else 0.0 for b in (_MODAL, _NEG)]
        novelty = None if k == 0 else len(kinds - known) / len(kinds) if kinds else 0.0
        known |= kinds
        out.append((k, len(cuts), size, first, first + size - 1, novelty, variance, *hits, level, low, high))
        first += size
    return out
