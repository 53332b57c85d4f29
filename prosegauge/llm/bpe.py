"""Byte-pair encoding and decoding by batched numpy merge rounds.

The symbols of many words lie in one flat array.  In every round each word's
lowest-rank adjacent pair is found by binary search over the sorted pair keys,
and merged in all words at once.  Every distinct piece (a run
of letters, a digit or a run of signs) is merged once per worker cache, so the
cost of merging follows distinct pieces, not words.

Defined results: null and blank texts give no ids and an empty decoded text;
repeated rows give repeated rows; special tokens that occur in a text become
their own ids, as the tokenizers library does; texts of any length are encoded
whole, long ones part by part, with memory for one text and one part; letters and
digits are those of Unicode 16, as in the library; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small_batches

_SPACE = "\t-\r \x85\xa0  -     　"
_NONE = np.int64(1 << 40)
#: Characters of distinct pieces that a worker remembers before it starts afresh (each piece counts PIECE more).
CACHE = 8_000_000
PIECE = 100
#: Characters of text that are cut into pieces at a time, and pieces of one text that are looked up at a time.
BLOCK = 400_000
STRIDE = 100_000
#: What the engine of the JSON, of Unicode 16, doesn't class as letters and digits though newer tables do.
_LATER_LETTERS = "0558 058B-058C 088F 0C5C 0CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DF1 16EA0-16EB8 16EBB-16ED3 16FF2-16FF3 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F"
_LATER_DIGITS = "11DE0-11DE9 1246F 12475-1247F 12550-12686 16FF4-16FF6"
#: Lower case that the library knows and Python's older tables don't.
_LOWER = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B} | {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}
#: Marks that the library's composition, of Unicode 9, takes for letters: nothing is put in order or composed across them.
_LATER_MARKS = "07FD 0898-089F 08CA-08D3 09FE 0C3C 0D3B-0D3C 0EBA 1715 1ABF-1ACE 1DF6-1DFA A82C 10D24-10D27 10EAB-10EAC 10EFD-10EFF 10F46-10F50 10F82-10F85 11070 1133B 1145E 11839-1183A 11930 1193D-1193E 11943 119E0 11A34 11A47 11A99 11D42 11D44-11D45 11D97 11F41-11F42 16FF0-16FF1 1E08F 1E130-1E136 1E2AE 1E2EC-1E2EF 1E4EC-1E4EF"


def _class(ranges: str) -> str:
    return "".join("-".join(chr(int(c, 16)) for c in r.split("-")) for r in ranges.split())


_UNLIKE = re.compile(f"[{_class(_LATER_LETTERS)}{_class(_LATER_DIGITS)}{''.join(map(chr, _LOWER))}]")
#: All that the tables class differently lies in this range.
_FAR = re.compile("[\u0558-\U0010ffff]")
_MARKS = re.compile(f"([{_class(_LATER_MARKS)}])")


def composed(text: str) -> str:
    return unicodedata.normalize("NFC", text) if not _MARKS.search(text) else "".join(unicodedata.normalize("NFC", part) for part in _MARKS.split(text))


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    extra = iter(range(256, 512))
    return [chr(b) if b in keep else chr(next(extra)) for b in range(256)]


class BatchedBpe:
    """A word-end BPE read from a tokenizers JSON file."""

    def __init__(self, path: str):
        import regex

        spec = json.load(open(path, encoding="utf-8"))
        model, steps = spec["model"], spec["normalizer"]["normalizers"]
        kinds = [s["type"] for s in steps]
        split = spec["pre_tokenizer"]["pretokenizers"]
        if model["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"] or spec["decoder"] or spec["post_processor"] or [s["type"] for s in split] != ["Split", "ByteLevel"] or not split[0]["invert"]:
            raise ValueError(f"{path}: a tokenizer of another kind")
        vocab, end = model["vocab"], model["end_of_word_suffix"] or ""
        self.tokens = [""] * (1 + max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]))
        for token, i in vocab.items():
            self.tokens[i] = token
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for token, i in self.special.items():
            self.tokens[i] = token
        order = sorted(self.special, key=len, reverse=True)
        self.special_re = regex.compile("(" + "|".join(map(regex.escape, order)) + ")") if order else None
        # Replace turned white space into U+0020, so the class \s is that of the JSON's engine
        pattern = split[0]["pattern"]["Regex"].replace("\\s", _SPACE)
        self.piece_re = regex.compile(pattern)
        letter, digit = rf"[\p{{L}}--[{_class(_LATER_LETTERS)}]]", rf"[\p{{N}}--[{_class(_LATER_DIGITS)}]]"
        rest = regex.search(r"\[\^[^]]*\]\+$", pattern)
        if not rest or pattern.count("\\p{L}") != 2 or pattern.count("\\p{N}") != 2:
            raise ValueError(f"{path}: pieces of another pattern")
        words = pattern[: rest.start()].replace("[\\p{L}]", letter).replace("[\\p{N}]", digit)
        self.pinned_re = regex.compile(f"(?V1){words}[^{_SPACE}{letter}{digit}]+")
        sym = byte_symbols()
        self.mid = np.array([vocab.get(s, -1) for s in sym], np.int64)
        self.end = np.array([vocab.get(s + end, -1) for s in sym], np.int64)
        self.size = len(self.tokens)
        pairs = [p if isinstance(p, list) else p.split(" ") for p in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        key = left * self.size + right
        at = np.argsort(key, kind="stable")
        self.keys, self.rank, self.made = key[at], at.astype(np.int64), made
        # a merge is safe to do everywhere at once if its product takes part in later merges only
        first = np.full(self.size, _NONE)
        ranks = np.arange(len(made), dtype=np.int64)
        np.minimum.at(first, left, ranks)
        np.minimum.at(first, right, ranks)
        self.safe = first[made] > ranks
        self.digits = [str(i) for i in range(self.size)]
        self.forget()

    def forget(self) -> None:
        self.cache: dict[str, tuple[str, str]] = {name: (str(i), name) for name, i in self.special.items()}
        self.held = 0

    def pieces(self, text: str) -> Iterator[list[str]]:
        """The pieces of a text in order, at most STRIDE at a time; the name of a special token is itself a piece."""
        parts = self.special_re.split(text) if self.special_re and any(name in text for name in self.special) else [text]
        for part in parts:
            if part in self.special:
                yield [part]
            else:
                far = not part.isascii() and _FAR.search(part) is not None
                unlike = far and _UNLIKE.search(part) is not None
                cut, low = self.pinned_re if unlike else self.piece_re, self.lower(part, far, unlike)
                if len(part) <= BLOCK:
                    yield cut.findall(low)
                else:
                    found = cut.finditer(low)
                    while some := [m[0] for m in islice(found, STRIDE)]:
                        yield some

    @staticmethod
    def lower(text: str, far: bool, unlike: bool) -> str:
        """far: whether any character is beyond those that all tables agree on; unlike: whether the tables differ on one."""
        if text.isascii():
            return text.lower()
        text = (composed(text) if far else unicodedata.normalize("NFC", text)).replace("Σ", "σ").lower()
        return text.translate(_LOWER) if unlike else text

    def merge(self, pieces: list[str]) -> tuple[list[int], list[int]]:
        """All ids of the pieces in order, and where each piece ends among them."""
        raw = [p.encode("utf-8") for p in pieces]
        lens = np.fromiter(map(len, raw), np.int64, len(raw))
        data = np.frombuffer(b"".join(raw), np.uint8)
        sym, word = self.mid[data], np.repeat(np.arange(len(raw)), lens)
        last = np.cumsum(lens) - 1
        sym[last] = self.end[data[last]]
        done_sym, done_word = [], []
        while len(sym):
            pair = np.full(len(sym), _NONE)
            if len(sym) > 1:
                key = sym[:-1] * self.size + sym[1:]
                at = np.searchsorted(self.keys, key)
                at[at == len(self.keys)] = 0
                hit = (self.keys[at] == key) & (word[:-1] == word[1:])
                pair[:-1][hit] = self.rank[at[hit]]
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            best = np.minimum.reduceat(pair, starts)
            size = np.diff(np.r_[starts, len(sym)])
            over = np.repeat(best == _NONE, size)
            if over.any():  # words without a pair leave the array
                done_sym.append(sym[over])
                done_word.append(word[over])
                sym, word, pair = sym[~over], word[~over], pair[~over]
                live = best != _NONE
                best, size = best[live], size[live]
                if not len(sym):
                    break
            each = np.repeat(best, size)
            take = np.flatnonzero(pair == each)
            # of overlapping hits, every second from the left; where not safe, the first of its word
            run = np.r_[True, (np.diff(take) != 1) | (word[take][1:] != word[take][:-1])]
            index = np.arange(len(take))
            begin = np.maximum.accumulate(np.where(run, index, 0))
            ok = (index - begin) % 2 == 0
            head = np.r_[True, word[take][1:] != word[take][:-1]]
            take = take[ok & (self.safe[pair[take]] | head)]
            sym[take] = self.made[pair[take]]
            keep = np.ones(len(sym), bool)
            keep[take + 1] = False
            sym, word = sym[keep], word[keep]
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        flat = sym[np.argsort(word, kind="stable")].tolist()
        ends = np.cumsum(np.bincount(word, minlength=len(raw))).tolist()
        return flat, ends

    def learn(self, fresh: list[str]) -> None:
        """Put new pieces into the cache: (ids, tokens), each joined by a space."""
        flat, ends = self.merge(fresh)
        ids, tokens = [self.digits[i] for i in flat], [self.tokens[i] for i in flat]
        begin = 0
        self.held += sum(map(len, fresh)) + PIECE * len(fresh)
        for piece, end in zip(fresh, ends, strict=True):
            if end - begin == 1:
                self.cache[piece] = ids[begin], tokens[begin]
            else:
                self.cache[piece] = " ".join(ids[begin:end]), " ".join(tokens[begin:end])
            begin = end

    def encode(self, texts: list[str | None]) -> Iterator[Iterator[tuple[str, str]]]:
        """For each text its consecutive parts as (ids, decoded text), ids in decimal joined by a space.  Parts are joined by a space, too.

        New pieces of all short texts are merged in one go; a long text is cut into pieces as its parts are read.
        """
        cut = [list(self.pieces(t or "")) if len(t or "") <= BLOCK else None for t in texts]
        self.learn_new(set().union(*(pieces for own in cut if own for pieces in own)))
        for t, own in zip(texts, cut, strict=True):
            yield (self.known(pieces) for pieces in (self.pieces(t) if own is None else own) if pieces)

    def learn_new(self, pieces: set[str]) -> None:
        if self.held > CACHE:
            self.forget()
        if fresh := pieces.difference(self.cache):
            self.learn(list(fresh))

    def known(self, pieces: list[str]) -> tuple[str, str]:
        try:
            both = [self.cache[p] for p in pieces]
        except KeyError:  # a long text's piece, or one that was forgotten since
            self.learn_new(set(pieces))
            both = [self.cache[p] for p in pieces]
        return " ".join([b[0] for b in both]), " ".join([b[1] for b in both])


def _batches(it, path: str, convert):
    """Rows in blocks of bounded text, so that memory follows the longest text and not the batch."""
    bpe = BatchedBpe(path)
    for batch in it:
        ids, texts = batch.column(0), batch.column(1)
        start = 0
        while start < batch.num_rows:
            stop, rows = start, []
            size = 0
            while stop < batch.num_rows and (size == 0 or size < BLOCK):
                rows.append(texts[stop].as_py())
                size += len(rows[-1] or "") + PIECE
                stop += 1
            yield pa.RecordBatch.from_arrays([ids.slice(start, stop - start), *convert(bpe, rows)], names=["id", "a", "b", "c"])
            start = stop


def _whole(bpe: BatchedBpe, texts: list[str | None]):
    parts = [list(own) for own in bpe.encode(texts)]
    ids = [[int(i) for a, _ in own for i in a.split()] for own in parts]
    return [pa.array(map(len, ids), pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array([" ".join([b for _, b in own]) for own in parts], pa.string())]


def _digests(bpe: BatchedBpe, texts: list[str | None]):
    """Digests grow part by part, so the ids of a long text are never held at once."""
    counts, ids, decoded = [], [], []
    for own in bpe.encode(texts):
        n, one, two, gap = 0, hashlib.sha256(), hashlib.sha256(), ""
        for a, b in own:
            n += a.count(" ") + 1
            one.update(f"{gap}{a}".encode())
            two.update(f"{gap}{b}".encode())
            gap = " "
        counts.append(n)
        ids.append(one.hexdigest())
        decoded.append(two.hexdigest())
    return [pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())]


def _run(df: DataFrame, path: str, id_col: str, text_col: str, convert, kinds: list[str], names: list[str]) -> DataFrame:
    kind = dict(df.dtypes)[id_col]
    small_batches(df.sparkSession)
    return df.select(df[id_col].alias("id"), df[text_col].alias("t")).mapInArrow(lambda it: _batches(it, path, convert), f"id {kind}, a bigint, b {kinds[0]}, c {kinds[1]}").toDF(id_col, *names)


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids (array<int>), decoded."""
    return _run(df, path, id_col, text_col, _whole, ["array<int>", "string"], ["n_tokens", "ids", "decoded"])


def encode_digests(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256: encode() reduced on the worker."""
    return _run(df, path, id_col, text_col, _digests, ["string", "string"], ["n_tokens", "ids_sha256", "decoded_sha256"])


def decode(df: DataFrame, path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Adds the decoded text of an array of ids; null ids give a null."""

    small_batches(df.sparkSession)

    def run(it):
        tokens = BatchedBpe(path).tokens
        for batch in it:
            got = [None if v is None else " ".join(tokens[i] for i in v if 0 <= i < len(tokens) and tokens[i]) for v in batch.column(ids_col).to_pylist()]
            arrays = [batch.column(n) for n in batch.schema.names if n != out_col]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(got, pa.string())], names=[*(n for n in batch.schema.names if n != out_col), out_col])

    from pyspark.sql import types as T

    schema = T.StructType([f for f in df.schema.fields if f.name != out_col] + [T.StructField(out_col, T.StringType())])
    return df.mapInArrow(run, schema)
