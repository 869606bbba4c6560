"""BPE encoding and decoding with a minimal acyclic transducer of the frequent words.

The words that the pre-tokeniser cuts are counted over the whole corpus. The most frequent ones
are compiled, with their ids, into an acyclic automaton whose equal suffixes are shared. Its
arcs carry numbers that add up to the rank of the word, and the rank points to the word's ids.
The automaton is a flat file that workers map into memory. Words outside are merged pair by pair
by the ranks of the tokenizer file, which gives the same ids as the lexicon would.

The lexicon is bounded by its number of words, so it is small enough to send to every worker
whatever the size of the corpus; it changes speed only, never ids.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
import tempfile
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanternflow.llm.common import Recent, durable, gathered, give_back, piece_groups

SHORT = 24       # words of more letters are merged with a heap
GROUP = 2 << 20  # bytes of texts that are cut together
# Runs of these characters are lower-cased and cut the same way by Python and by the library:
# Latin letters without combining marks, and no controls. Others are cut by the library itself.
_PLAIN = re.compile(r"[\x20-\x7e\xa1-įı-ž]*\Z")


# The automaton ---------------------------------------------------------------------------

def build_automaton(words: list[bytes]) -> dict[str, np.ndarray]:
    """Minimal acyclic automaton of sorted distinct words as flat arrays.

    ``arc_key`` is state * 256 + byte in ascending order, ``arc_to`` the target, ``arc_add`` the
    number of smaller words that the arc skips; ``final`` marks accepting states. State 0 is the start.
    """
    register: dict[tuple, int] = {}
    arcs_of: list[tuple] = []   # frozen states: (final, ((byte, state), ...))

    def freeze(node: list) -> int:
        sign = (node[0], tuple(node[1]))
        state = register.get(sign)
        if state is None:
            state = register[sign] = len(arcs_of)
            arcs_of.append(sign)
        return state

    path = [[False, []]]        # open states along the last word
    last = b""
    for word in words:
        common = len(os.path.commonprefix([last, word]))
        for i in range(len(last), common, -1):
            path[i - 1][1].append((last[i - 1], freeze(path.pop())))
        path += [[False, []] for _ in range(len(word) - common)]
        path[-1][0] = True
        last = word
    for i in range(len(last), 0, -1):
        path[i - 1][1].append((last[i - 1], freeze(path.pop())))
    start = freeze(path[0])
    # Children are frozen before their parents, so counts follow in order of number.
    below = []
    for final, arcs in arcs_of:
        below.append(int(final) + sum(below[s] for _, s in arcs))
    n = len(arcs_of)
    number = lambda s: 0 if s == start else s + 1 if s < start else s
    keys, to, add = [], [], []
    final = np.zeros(n, np.uint8)
    for s in [start, *[i for i in range(n) if i != start]]:
        is_final, arcs = arcs_of[s]
        final[number(s)] = is_final
        skipped = int(is_final)
        for byte, t in arcs:
            keys.append(number(s) * 256 + byte)
            to.append(number(t))
            add.append(skipped)
            skipped += below[t]
    return {"arc_key": np.array(keys, np.uint64), "arc_to": np.array(to, np.uint32), "arc_add": np.array(add, np.uint32), "final": final}


class Lexicon:
    """Words to ids through a memory-mapped automaton."""

    ARRAYS = (("arc_key", np.uint64), ("ids_at", np.uint64), ("arc_to", np.uint32), ("arc_add", np.uint32), ("ids", np.uint32), ("final", np.uint8))

    @classmethod
    def compile(cls, words: dict[bytes, list[int]]) -> bytes:
        order = sorted(words)
        parts = build_automaton(order) | {
            "ids_at": np.cumsum([0, *[len(words[w]) for w in order]]).astype(np.uint64),
            "ids": np.array([i for w in order for i in words[w]], np.uint32)}
        head = np.array([len(parts[k]) for k, _ in cls.ARRAYS], np.uint64)
        return b"".join([head.tobytes(), *[parts[k].tobytes() for k, _ in cls.ARRAYS]])

    def __init__(self, data: bytes):
        # A file without a name in the worker's own temporary folder: it goes with the worker.
        with tempfile.TemporaryFile() as f:
            f.write(data)
            f.flush()
            mapped = np.asarray(np.memmap(f, np.uint8, "r"))
        at = 8 * len(self.ARRAYS)
        for (name, kind), n in zip(self.ARRAYS, mapped[:at].view(np.uint64).tolist()):
            size = n * np.dtype(kind).itemsize
            setattr(self, name, mapped[at:at + size].view(kind))
            at += size

    def ranks(self, words: list[bytes]) -> np.ndarray:
        """Rank of each word, or -1; all words walk the automaton together, a byte at a time."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        rank = np.where(sizes > 0, 0, -1)
        if not len(self.arc_key) or not len(words):
            return np.full(len(words), -1)
        flat, start = np.frombuffer(b"".join(words), np.uint8), np.cumsum(sizes) - sizes
        state, live = np.zeros(len(words), np.uint64), np.flatnonzero(sizes > 0)
        step = 0
        while len(live):
            key = state[live] * np.uint64(256) + flat[start[live] + step]
            arc = np.minimum(np.searchsorted(self.arc_key, key), len(self.arc_key) - 1)
            hit = self.arc_key[arc] == key
            rank[live[~hit]] = -1
            live, arc = live[hit], arc[hit]
            rank[live] += self.arc_add[arc]
            state[live] = self.arc_to[arc]
            step += 1
            ended = sizes[live] == step
            done = live[ended]
            rank[done[self.final[state[done].astype(np.int64)] == 0]] = -1
            live = live[~ended]
        return rank

    def ids_of(self, rank: int) -> list[int]:
        return self.ids[int(self.ids_at[rank]):int(self.ids_at[rank + 1])].tolist()

    def ids_of_all(self, ranks: np.ndarray) -> list[list[int] | None]:
        """The ids of each rank; None for -1."""
        known = np.flatnonzero(ranks >= 0)
        start, end = (self.ids_at[ranks[known] + k].astype(np.int64) for k in (0, 1))
        n = end - start
        flat = self.ids[np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())].tolist()
        out: list[list[int] | None] = [None] * len(ranks)
        for i, a, b in zip(known.tolist(), (np.cumsum(n) - n).tolist(), np.cumsum(n).tolist()):
            out[i] = flat[a:b]
        return out


# The tokenizer file ----------------------------------------------------------------------

def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes for
    themselves, the others numbered from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256))
    return [chr(b) if b in plain else chr(256 + next(rest)) for b in range(256)]


class Bpe:
    """Vocabulary, merges and special strings of a byte-level tokenizer file with a word-end mark."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token_of = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        # Pair of ids -> rank of its merge and the id that it makes, in one number that sorts by rank.
        self.pair = {self.vocab[a] << 20 | self.vocab[b]: i << 20 | self.vocab[a + b] for i, (a, b) in enumerate(model["merges"])}
        self.letters = byte_letters()
        self.byte_of = {c: b for b, c in enumerate(self.letters)}
        self.first = [self.vocab[c] for c in self.letters]
        self.last = [self.vocab[c + self.end] for c in self.letters]
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.cut = regex.compile(split)
        self.specials = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.library = Tokenizer.from_file(path)

    def pretokens(self, text: str) -> list[bytes]:
        """Words of a text without special strings, as bytes."""
        if _PLAIN.match(text):
            return [w.encode() for w in self.cut.findall(text.lower())]
        normal = self.library.normalizer.normalize_str(text)
        return [bytes(map(self.byte_of.__getitem__, w)) for w, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]

    def split(self, run: str) -> list[int | bytes]:
        """Special ids and words of a run of characters, in order."""
        if not run:
            return []
        if run.isascii():  # the common cases: a word, and a word before a stop or comma
            if run.isalpha():
                return [run.lower().encode()]
            if run[-1] in ".,;:?" and (word := run[:-1]).isalpha():
                return [word.lower().encode(), run[-1].encode()]
        if self.specials is None or not self.specials.search(run):
            return self.pretokens(run)
        out: list[int | bytes] = []
        for part in self.specials.split(run):
            out += [self.special[part]] if part in self.special else self.pretokens(part)
        return out

    def merge(self, word: bytes) -> list[int]:
        """Ids of a word: the adjacent pair of lowest rank is joined, leftmost first, until none is left."""
        if not word:
            return []
        ids = [*map(self.first.__getitem__, word[:-1]), self.last[word[-1]]]
        return self._merge_long(ids) if len(ids) > SHORT else self._merge_short(ids)

    def merge_unseen(self, word: bytes) -> list[int]:
        """The same merges, done by the library's model: for the many words outside the lexicon."""
        letters = word.decode() if word.isalpha() else "".join([self.letters[b] for b in word])
        return [t.id for t in self.library.model.tokenize(letters)]

    def _merge_short(self, ids: list[int]) -> list[int]:
        found, none = self.pair.get, 1 << 60
        ranks = [found(a << 20 | b, none) for a, b in zip(ids, ids[1:])]
        while ranks and (best := min(ranks)) < none:
            i = ranks.index(best)
            ids[i] = best & 0xFFFFF
            del ids[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = found(ids[i] << 20 | ids[i + 1], none)
            if i:
                ranks[i - 1] = found(ids[i - 1] << 20 | ids[i], none)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same in n log n: a linked list of parts and a heap of (rank, place), checked when taken."""
        found, n = self.pair.get, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i, (a, b) in enumerate(zip(ids, ids[1:])) if (r := found(a << 20 | b)) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n or found(ids[i] << 20 | ids[j]) != rank:
                continue  # one of the two has been joined since
            ids[i], ids[j] = rank & 0xFFFFF, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := found(ids[i] << 20 | ids[k])) is not None:
                    heapq.heappush(heap, (r, i))
            if (h := before[i]) >= 0 and (r := found(ids[h] << 20 | ids[i])) is not None:
                heapq.heappush(heap, (r, h))
        return [p for p in ids if p >= 0]


@lru_cache(maxsize=1)
def bpe_file(path: str) -> Bpe:
    return Bpe(path)


# On Spark --------------------------------------------------------------------------------

def word_counts(docs: DataFrame, path: str, most: int = 12 << 20) -> DataFrame:
    """``word, n`` over all texts; each task sums up before the shuffle, in about ``most`` bytes."""
    def run(batches):
        bpe, seen, held = bpe_file(path), Counter(), 0

        def flush():
            words: Counter = Counter()
            for r, n in seen.items():
                for w in bpe.split(r):
                    if isinstance(w, bytes):
                        words[w] += n
            seen.clear()
            return pa.record_batch([pa.array(list(words), pa.binary()), pa.array(list(words.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for pieces, at, _ in piece_groups(batch.column("text"), GROUP):
                before = len(seen)
                for r, n in zip(pieces, np.bincount(at, minlength=len(pieces)).tolist()):
                    seen[r] += n
                held += (len(seen) - before) * 150 + sum(len(r) for r in pieces if len(r) > 64)
                if held > most:
                    yield flush()
                    held = 0
        yield flush()
        give_back()

    return docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def cutoff(counts: DataFrame, most: int, ways: int = 32) -> int:
    """The least c for which at most ``most`` rows of ``counts(n)`` have n > c: a search by counting, ``ways`` guesses a pass."""
    top = counts.agg(F.max("n")).first()[0] or 0
    low, high = -1, top  # too many above low (or nothing known), few enough above high
    while high - low > 1:
        guesses = sorted({low + (high - low) * i // ways for i in range(1, ways)} - {low})
        above = counts.agg(*[F.count_if(F.col("n") > g).alias(str(g)) for g in guesses]).first()
        fits = [g for g, n in zip(guesses, above) if n <= most]
        high = fits[0] if fits else high
        low = max([g for g in guesses if g < high], default=low)
        if high == 0 or not guesses:
            break
    return high


def build_lexicon(docs: DataFrame, path: str, words: int = 262_144, letters: int = 64) -> bytes:
    """The most frequent words of all texts, compiled: at most ``words`` of up to ``letters`` bytes.

    Words that tie at the last place are left out together; what is left out is merged where it occurs.
    """
    bpe = bpe_file(path)
    counts = durable(word_counts(docs, path).filter(F.length("word") <= letters))
    # Chosen by a count alone, so that no task and not the driver sees more than these words.
    top = counts.filter(F.col("n") > cutoff(counts, words)).select("word").collect()
    return Lexicon.compile({bytes(r["word"]): bpe.merge(bytes(r["word"])) for r in top})


class Codec:
    """Encodes and decodes texts; keeps the results of lately used pieces."""

    def __init__(self, path: str, lexicon: bytes):
        self.bpe, self.lexicon = bpe_file(path), Lexicon(lexicon)
        self.digits, self.tokens = ({i: f"{x} " for i, x in pairs} for pairs in (
            zip(self.bpe.token_of, self.bpe.token_of), self.bpe.token_of.items()))
        self.runs = Recent(self._encode_runs, lambda k, v: 350 + 2 * len(k) + len(v[1]) + len(v[2]), 12 << 20)

    def _encode_runs(self, runs: list[str]) -> Iterator[tuple[int, bytes, bytes]]:
        """Number of ids, decimal ids and tokens, each followed by a space. All words walk the automaton
        together; the ones that it doesn't hold are merged."""
        cut, merge, digits, tokens = [self.bpe.split(r) for r in runs], self.bpe.merge_unseen, self.digits, self.tokens
        words = [w for c in cut for w in c if isinstance(w, bytes)]
        known = iter(self.lexicon.ids_of_all(self.lexicon.ranks(words)))
        for c in cut:
            ids: list[int] = []
            for w in c:
                if isinstance(w, int):
                    ids.append(w)
                else:
                    ids += next(known) or merge(w)
            yield len(ids), "".join(map(digits.__getitem__, ids)).encode(), "".join(map(tokens.__getitem__, ids)).encode()

    def many(self, texts: pa.Array) -> Iterator[tuple[int, memoryview, memoryview]]:
        """(number of ids, decimal ids joined by a space, decoded text) of each text."""
        for pieces, at, offsets in piece_groups(texts, GROUP):
            counts, ids, tokens = zip(*self.runs.fetch(pieces))
            total = np.concatenate([[0], np.cumsum(np.array(counts, np.int64)[at])])[offsets]
            (x, i), (y, j) = gathered(ids, at, offsets), gathered(tokens, at, offsets)
            for k in range(len(offsets) - 1):
                yield int(total[k + 1] - total[k]), x[i[k]:max(i[k], i[k + 1] - 1)], y[j[k]:max(j[k], j[k + 1] - 1)]


def _with_codec(docs: DataFrame, path: str, words: int):
    held = docs.sparkSession.sparkContext.broadcast(build_lexicon(docs, path, words))
    return lambda: Codec(path, held.value)  # for one task: a worker that goes on to other stages keeps nothing of it


def encode_decode(docs: DataFrame, path: str, words: int = 262_144) -> DataFrame:
    """``doc_id, n_tokens, ids (list), decoded`` of every row of ``docs(doc_id, text, ...)``.

    Null and empty texts have no ids and decode to an empty text. No special ids are added; the
    tokenizer's special strings inside a text give their ids. Decoding joins the tokens by one
    space, word-end marks included, as the tokenizer file names no decoder. Repeated rows
    are encoded each; other columns are not carried.
    """
    codec_of = _with_codec(docs, path, words)

    def run(batches):
        codec = codec_of()
        for batch in batches:
            ids, decoded = [], []
            for _, i, d in codec.many(batch.column("text")):
                ids.append(np.array(bytes(i).split(), np.int32))
                decoded.append(bytes(d).decode())
            yield pa.record_batch([batch.column("doc_id"), pa.array([len(i) for i in ids], pa.int64()),
                                   pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())],
                                  ["doc_id", "n_tokens", "ids", "decoded"])
        del codec
        give_back()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, decoded string")


def encoding_digest(docs: DataFrame, path: str, words: int = 262_144) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every row (see ``encode_decode``)."""
    codec_of = _with_codec(docs, path, words)

    def run(batches):
        codec = codec_of()
        for batch in batches:
            out = []
            for n, i, d in codec.many(batch.column("text")):
                out.append((n, hashlib.sha256(i).hexdigest(), hashlib.sha256(d).hexdigest()))
            n, i, d = zip(*out) if out else ((), (), ())
            yield pa.record_batch([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(i, pa.string()), pa.array(d, pa.string())],
                                  ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        del codec
        give_back()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
