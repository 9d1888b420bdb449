"""Byte-level BPE over whole corpora: speculate and verify.

Each distinct word of a batch gets its tokens proposed by greedy longest match (one automaton pass over all new words).
A proposal is the exact encoding if and only if every two adjacent tokens are compatible: no merge across their seam
would have come before the merges that built them. That test is vectorised over all adjacent pairs of the batch and
remembered by pair. Only words with a failing pair are merged exactly.

Null and empty texts encode to the empty list. Texts of any length are encoded whole; special tokens' strings are
ordinary text.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from itertools import islice, repeat

import numpy as np

from streamroute.session import spread

#: Names of files in the tokenizer folder; the path itself is a parameter.
DEFAULT_TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"

#: Fixed value: the split pattern of the byte-level tokenizers.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

NEVER = np.int64(1 << 40)
#: Entries kept by a worker in the word cache and in the pair cache before they start anew.
WORDS_KEPT, PAIRS_KEPT = 300_000, 2_000_000
#: Characters encoded at once; longer texts are cut between words.
BLOCK_CHARS, BLOCK_WORDS = 2_000_000, 400_000


def printable_bytes() -> dict[str, int]:
    """The usual mapping of printable stand-ins to bytes in vocabulary files: visible Latin-1 stands for itself, the rest counts up from 256."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Speculator:
    """Encoder with the tables of one vocabulary file (tokenizers' JSON form with vocab and merges)."""

    def __init__(self, path: str):
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        back = printable_bytes()
        self.split = regex.compile(SPLIT)
        self.bytes_of: dict[int, bytes] = {i: bytes(back[c] for c in t) for t, i in model["vocab"].items() if all(c in back for c in t)}
        self.id_of = {b: i for i, b in self.bytes_of.items()}
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        vocab = model["vocab"]
        self.size = max(vocab.values()) + 1
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        rank = np.arange(len(pairs), dtype=np.int64)
        order = np.argsort(left * self.size + right)
        self.codes, self.ranks = (left * self.size + right)[order], rank[order]
        self.merge = {(int(a), int(b)): (int(r), int(m)) for a, b, r, m in zip(left, right, rank, made)}
        # parts of a token by the merge that makes it first, and that merge's rank
        part = np.full((2, self.size), -1, np.int64)
        born = np.full(self.size, NEVER, np.int64)
        for a, b, m, r in zip(left[::-1], right[::-1], made[::-1], rank[::-1]):
            part[0, m], part[1, m], born[m] = a, b, r
        self.right_spine = self._spine(part[1], born)
        self.left_spine = self._spine(part[0], born)
        self.automaton = ahocorasick.Automaton()
        self.length = np.zeros(self.size, np.int64)
        for i, b in self.bytes_of.items():
            self.automaton.add_word(b.decode("latin-1"), i)
            self.length[i] = len(b)
        self.automaton.make_automaton()
        self.pair_code, self.pair_ok = np.empty(0, np.int64), np.empty(0, bool)
        self.proposed = self.merged = 0
        self._forget()

    def _spine(self, part: np.ndarray, born: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per depth: the token at the seam, and the rank at which its parent consumes it (NEVER for the token itself, -1 for none)."""
        node, eaten = np.arange(self.size, dtype=np.int64), np.full(self.size, NEVER, np.int64)
        levels = []
        while (node >= 0).any():
            levels.append((node.copy(), eaten.copy()))
            eaten = np.where(node >= 0, born[node], -1)
            node = np.where(node >= 0, part[node], -1)
        return levels

    def _forget(self) -> None:
        self.index: dict[str, int] = {}
        self.flat, self.used = np.empty(1 << 16, np.int32), 0
        self.start, self.count = np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int64)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair of tokens: does BPE of their joined bytes give just these two?

        With x on the right edge of a's merge tree and y on the left edge of b's: x and y would merge across the seam
        if their merge comes before x's own parent (strictly: of equal merges the left one goes first) and not after
        y's parent.
        """
        ok = np.ones(len(a), bool)
        for x_node, x_eaten in self.right_spine:
            x, px = x_node[a], x_eaten[a]
            if not (x >= 0).any():
                break
            for y_node, y_eaten in self.left_spine:
                y, py = y_node[b], y_eaten[b]
                live = ok & (x >= 0) & (y >= 0)
                at = np.flatnonzero(live)
                if not len(at):
                    break
                code = x[at] * self.size + y[at]
                pos = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
                hit = self.codes[pos] == code
                r = self.ranks[pos]
                ok[at[hit & (r < px[at]) & (r <= py[at])]] = False
        return ok

    def _verdicts(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        code, inverse = np.unique(a * self.size + b, return_inverse=True)
        pos = np.searchsorted(self.pair_code, code)
        known = np.zeros(len(code), bool)
        if len(self.pair_code):
            known = self.pair_code[np.minimum(pos, len(self.pair_code) - 1)] == code
        ok = np.zeros(len(code), bool)
        ok[known] = self.pair_ok[pos[known]]
        new = code[~known]
        if len(new):
            ok[~known] = self.compatible(new // self.size, new % self.size)
            if len(self.pair_code) + len(new) > PAIRS_KEPT:
                self.pair_code, self.pair_ok = np.empty(0, np.int64), np.empty(0, bool)
            every = np.concatenate([self.pair_code, new])
            verdict = np.concatenate([self.pair_ok, ok[~known]])
            order = np.argsort(every, kind="stable")
            self.pair_code, self.pair_ok = every[order], verdict[order]
        return ok[inverse]

    def exact(self, word: bytes) -> list[int]:
        """BPE of one word by its merges in rank order: a heap of seams over a doubly linked list."""
        ids = [self.id_of[word[i : i + 1]] for i in range(len(word))]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m[0], i, ids[i], ids[i + 1], m[1]) for i in range(n - 1) if (m := self.merge.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = made, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
                if m := self.merge.get((made, ids[after[i]])):
                    heapq.heappush(heap, (m[0], i, made, ids[after[i]], m[1]))
            h = before[i]
            if h >= 0 and (m := self.merge.get((ids[h], made))):
                heapq.heappush(heap, (m[0], h, ids[h], made, m[1]))
        return [x for x in ids if x >= 0]

    def _learn(self, words: list[str]) -> None:
        """Tokens of words not yet in the cache."""
        raw = [w.encode() for w in words]
        text = "Ā".join([b.decode("latin-1") for b in raw])
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        begin = np.zeros(len(raw), np.int64)
        np.cumsum(size[:-1] + 1, out=begin[1:])
        got = list(self.automaton.iter_long(text))
        end = np.fromiter((e for e, _ in got), np.int64, len(got))
        token = np.fromiter((t for _, t in got), np.int64, len(got))
        word = np.searchsorted(begin, end, side="right") - 1
        # a proposal covers its word when its lengths add up; tokens never hold the separator
        covered = np.bincount(word, self.length[token], len(raw)).astype(np.int64) == size
        inner = np.flatnonzero(word[1:] == word[:-1])
        bad = ~covered
        if len(inner):
            verdict = self._verdicts(token[inner], token[inner + 1])
            bad[word[inner[~verdict]]] = True
        self.proposed += len(raw)
        self.merged += int(bad.sum())
        count = np.bincount(word, minlength=len(raw)).astype(np.int64)
        if bad.any():
            wrong = np.flatnonzero(bad)
            fixed = [self.exact(raw[i]) for i in wrong]
            keep = ~bad[word]
            for_word = np.concatenate([word[keep], np.repeat(wrong, [len(x) for x in fixed])])
            token = np.concatenate([token[keep], np.fromiter((t for x in fixed for t in x), np.int64)])
            token = token[np.argsort(for_word, kind="stable")]
            count[wrong] = [len(x) for x in fixed]
        first = len(self.index)
        need = first + len(raw)
        while len(self.start) < need:
            self.start, self.count = np.resize(self.start, 2 * len(self.start)), np.resize(self.count, 2 * len(self.count))
        while len(self.flat) < self.used + len(token):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.flat[self.used : self.used + len(token)] = token
        self.count[first:need] = count
        self.start[first:need] = self.used + np.cumsum(count) - count
        self.used += len(token)
        self.index.update(zip(words, range(first, need)))

    def _numbers(self, words: list[str]) -> np.ndarray:
        at = np.fromiter(map(self.index.get, words, repeat(-1)), np.int64, len(words))
        unknown = np.flatnonzero(at < 0)
        if len(unknown):
            if len(self.index) > WORDS_KEPT:
                self._forget()
                self._learn(list(dict.fromkeys(words)))
                return np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
            self._learn(list(dict.fromkeys([words[i] for i in unknown])))
            at[unknown] = np.fromiter((self.index[words[i]] for i in unknown), np.int64, len(unknown))
        return at

    def _tokens(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All tokens of a list of words, and how many each word has."""
        at = self._numbers(words)
        n = self.count[at]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        pos = np.arange(total) + np.repeat(self.start[at] - (ends - n), n)
        return self.flat[pos], n

    def encode_block(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all texts in a row, and the number of tokens of each."""
        words: list[str] = []
        n_words = np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            if t:
                before = len(words)
                words.extend(self.split.findall(t))
                n_words[i] = len(words) - before
        if not words:
            return np.empty(0, np.int32), n_words
        tokens, n = self._tokens(words)
        upto = np.concatenate([[0], np.cumsum(n)])
        bounds = np.concatenate([[0], np.cumsum(n_words)])
        return tokens, np.diff(upto[bounds])

    def encode_long(self, text: str) -> np.ndarray:
        """One very long text, so many words at a time."""
        found = (m.group() for m in self.split.finditer(text))
        parts = []
        while words := list(islice(found, BLOCK_WORDS)):
            parts.append(self._tokens(words)[0])
        return np.concatenate(parts) if parts else np.empty(0, np.int32)

    def encode(self, text: str | None) -> list[int]:
        return self.encode_block([text])[0].tolist()

    def blocks(self, texts: list[str | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(from, to, tokens, tokens per text) for runs of texts of bounded size."""
        i = 0
        while i < len(texts):
            j, chars = i, 0
            while j < len(texts) and (j == i or chars + len(texts[j] or "") <= BLOCK_CHARS):
                chars += len(texts[j] or "")
                j += 1
            if j == i + 1 and chars > BLOCK_CHARS:
                tokens = self.encode_long(texts[i])
                yield i, j, tokens, np.array([len(tokens)])
            else:
                yield (i, j, *self.encode_block(texts[i:j]))
            i = j


_LOADED: dict[str, Speculator] = {}


def speculator(path: str = DEFAULT_TOKENIZER) -> Speculator:
    """The worker's encoder for a file; built once a Python worker."""
    if path not in _LOADED:
        _LOADED[path] = Speculator(path)
    return _LOADED[path]


def encode_corpus(df, text: str = "text", keep: tuple[str, ...] = ("doc_id",), path: str = DEFAULT_TOKENIZER, ids: str = "ids"):
    """df's `keep` columns and an array<int> column of token ids; a narrow Arrow map without any shuffle."""
    import pyarrow as pa
    from pyspark.sql import types as T

    slim = spread(df.select(*keep, text))
    schema = T.StructType([*[slim.schema[k] for k in keep], T.StructField(ids, T.ArrayType(T.IntegerType(), False), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = speculator(path)
        for batch in batches:
            texts = batch.column(len(keep)).to_pylist()
            for i, j, tokens, n in enc.blocks(texts):
                offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                arr = pa.ListArray.from_arrays(pa.array(offsets), pa.array(tokens.astype(np.int32, copy=False)))
                yield pa.RecordBatch.from_arrays([*[batch.column(k).slice(i, j - i) for k in range(len(keep))], arr], names=[*keep, ids])

    return slim.mapInArrow(run, schema)


def count_tokens(df, text: str = "text", keep: tuple[str, ...] = ("doc_id",), path: str = DEFAULT_TOKENIZER, name: str = "n_tokens"):
    """df's `keep` columns and the number of tokens of the text (0 for null and empty)."""
    import pyarrow as pa
    from pyspark.sql import types as T

    slim = spread(df.select(*keep, text))
    schema = T.StructType([*[slim.schema[k] for k in keep], T.StructField(name, T.LongType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = speculator(path)
        for batch in batches:
            texts = batch.column(len(keep)).to_pylist()
            n = np.concatenate([c for *_, c in enc.blocks(texts)]) if texts else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(len(keep))], pa.array(n.astype(np.int64))], names=[*keep, name])

    return slim.mapInArrow(run, schema)
