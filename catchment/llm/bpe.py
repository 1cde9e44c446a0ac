"""BPE encoding and decoding by speculation and verification.

Every distinct word of a batch is first cut by greedy longest match (all words
step through the vocabulary trie together, in numpy). A token sequence is what
the merge rules give exactly when each adjacent pair of tokens is itself stable:
merging the two tokens' symbols from scratch gives the two tokens back. That test
runs on all adjacent pairs at once by undoing merges, latest first. Only words
with an unstable pair are merged step by step.

Tokenizer files: the ``tokenizers`` JSON format with a BPE model, byte-level
symbols and an end-of-word suffix; special tokens are cut out of the raw text
first; then NFC, per-character lower case, and the file's split pattern, of which
white space is dropped. A null text counts as empty. The decoder is the library's
for a file without one: token strings joined by a space.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Regex, Tokenizer, pre_tokenizers

from catchment.llm.common import small_batches

#: Characters of which all Unicode versions since 10 say the same; a text with others is
#: normalised and split by the tokenizers library, whose tables may be of another version.
COMMON = regex.compile(r"[\x00-\u0527\u1E00-\u1EFF\u2010-\u2064\u20A0-\u20BF\u2190-\u23FE\u3000-\u3029\u3041-\u3096\u30A1-\u30FA\u4E00-\u9FCC\uAC00-\uD7A3\U0001F300-\U0001F64F]*+")
#: Words kept with their codes by a task at most; the memory is emptied beyond, and after it.
MEMORY_WORDS = 150_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies, a fixed
    rule of the file format: printable Latin-1 bytes stand for themselves, the others, in
    order, for 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    later = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(later)) for b in range(256)]


class WordCodec:
    """Encodes words (pre-tokenised pieces) in batches."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        vocab: dict[str, int] = model["vocab"]
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in vocab.items()} | {i: t for t, i in self.specials.items()}
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(split["pattern"]["Regex"])
        self.normalizer = Tokenizer.from_file(path).normalizer
        self.splitter = pre_tokenizers.Split(Regex(split["pattern"]["Regex"]), split["behavior"].lower(), split["invert"])
        self.special_pattern = regex.compile("(" + "|".join(map(regex.escape, self.specials)) + ")")
        symbols = byte_symbols()
        of_symbol = {c: b for b, c in enumerate(symbols)}
        self.size = max(self.names) + 1
        self.inner = np.array([vocab[c] for c in symbols])
        self.last = np.array([vocab[c + self.suffix] for c in symbols])

        # merges: rank of each pair, and for each token the rank and halves it came from
        self.rank = {}
        made_by = np.full(self.size, -1, np.int64)
        left, right = np.full(self.size, -1, np.int64), np.full(self.size, -1, np.int64)
        for r, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            i, j, made = vocab[a], vocab[b], vocab[a + b]
            self.rank[i, j] = (r, made)
            if made_by[made] < 0:
                made_by[made], left[made], right[made] = r, i, j
        self.made_by, self.left, self.right = made_by, left, right
        keys = np.array([i * self.size + j for i, j in self.rank], np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], np.array([r for r, _ in self.rank.values()])[order]

        # trie over bytes, with 256 as the end of a word
        edges: dict[int, int] = {}
        accept = [-1]
        for text, i in vocab.items():
            ends = bool(self.suffix) and text.endswith(self.suffix)
            body = text[: -len(self.suffix)] if ends else text
            path_ = [of_symbol[c] for c in body] + [256] * ends
            node = 0
            for b in path_:
                node = edges.setdefault(node * 257 + b, len(accept))
                if node == len(accept):
                    accept.append(-1)
            accept[node] = i
        self.edge_keys = np.array(sorted(edges), np.int64)
        self.edge_to = np.array([edges[k] for k in self.edge_keys.tolist()], np.int64)
        self.accept = np.array(accept, np.int64)
        self.codes: dict[str, bytes] = {}
        self.texts: dict[str, bytes] = {}

    # --- speculation -----------------------------------------------------------
    def propose(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest match of all words: (word of each token, tokens), in order."""
        n = len(words)
        lengths = np.fromiter(map(len, words), np.int64, n)
        starts = np.concatenate([[0], np.cumsum(lengths + 1)])[:-1]
        flat = np.full(int((lengths + 1).sum()), 256, np.int64)
        inside = np.ones(len(flat), bool)
        inside[starts + lengths] = False
        flat[inside] = np.frombuffer(b"".join(words), np.uint8)
        stop = starts + lengths + 1
        word = np.arange(n)
        begin, at, node = starts.copy(), starts.copy(), np.zeros(n, np.int64)
        best, best_at = np.full(n, -1, np.int64), starts.copy()
        out_word, out_at, out_token = [], [], []
        while len(word):
            more = at < stop[word]
            key = node * 257 + flat[np.minimum(at, len(flat) - 1)]
            where = np.minimum(np.searchsorted(self.edge_keys, key), len(self.edge_keys) - 1)
            step = more & (self.edge_keys[where] == key)
            node = np.where(step, self.edge_to[where], 0)
            at = at + step
            hit = self.accept[node]
            good = step & (hit >= 0) & (at != stop[word] - 1)  # the end mark can't stand alone
            best, best_at = np.where(good, hit, best), np.where(good, at, best_at)
            done = ~step
            if done.any():
                out_word.append(word[done])
                out_at.append(begin[done])
                out_token.append(best[done])
                begin, at = np.where(done, best_at, begin), np.where(done, best_at, at)
                best = np.where(done, -1, best)
                keep = begin < stop[word]
                if not keep.all():
                    word, begin, at, node, best, best_at = (x[keep] for x in (word, begin, at, node, best, best_at))
        who, pos, token = map(np.concatenate, (out_word, out_at, out_token))
        order = np.argsort(pos, kind="stable")
        return who[order], token[order]

    # --- verification ----------------------------------------------------------
    def ranks_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair, or a rank beyond all."""
        key = a * self.size + b
        where = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[where] == key, self.pair_ranks[where], np.iinfo(np.int64).max)

    def stable(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging never crosses the border between tokens a and b.

        Undo, latest first, the merges on the border's right edge of a and left
        edge of b. A cross merge spoils the pair if it would come before the next
        merge that hides the border's symbols: a merge at the same rank in a
        stands to its left and wins, one in b stands to its right and loses."""
        ok = np.ones(len(a), bool)
        live = np.arange(len(a))
        a, b = a.copy(), b.copy()
        # the merge undone last: cross merges before it (or, on the right side, at it) win
        limit = np.full(len(a), np.iinfo(np.int64).max)
        while len(live):
            cross = self.ranks_of(a, b)
            bad = cross < limit
            ok[live[bad]] = False
            ra, rb = self.made_by[a], self.made_by[b]
            keep = ~bad & ((ra >= 0) | (rb >= 0))
            live, a, b, ra, rb = live[keep], a[keep], b[keep], ra[keep], rb[keep]
            from_a = ra > rb
            # equal ranks: both halves hold the same merge, the left one is done first
            limit = np.where(from_a, ra, rb + 1)
            a, b = np.where(from_a, self.right[a], a), np.where(from_a, b, self.left[b])
        return ok

    def merge(self, word: bytes) -> list[int]:
        """Exact merging: always the lowest rank, the leftmost on ties."""
        tokens = [int(self.inner[c]) for c in word[:-1]] + [int(self.last[word[-1]])]
        n = len(tokens)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (found := self.rank.get((tokens[i], tokens[j]))):
                heapq.heappush(heap, (found[0], i, tokens[i], tokens[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, x, y = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or tokens[i] != x or tokens[j] != y:
                continue
            tokens[i], alive[j], after[i] = self.rank[x, y][1], False, after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [t for t, live in zip(tokens, alive, strict=True) if live]

    def learn(self, words: list[str]) -> None:
        """Encode words that are not yet in memory."""
        raw = [w.encode() for w in words]
        who, token = self.propose(raw)
        same = who[1:] == who[:-1]
        a, b = token[:-1][same], token[1:][same]
        failing = set(np.unique(who[:-1][same][~self.stable_pairs(a, b)]).tolist()) | set(np.unique(who[token < 0]).tolist())
        cuts = np.flatnonzero(np.diff(who)) + 1
        for i, ids in enumerate(np.split(token, cuts)):
            ids = self.merge(raw[i]) if i in failing else ids.tolist()
            self.codes[words[i]] = np.array(ids, "<u4").tobytes()
            self.texts[words[i]] = self.decode(ids).encode()

    def stable_pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``stable`` of each distinct pair, dealt back."""
        bad = (a < 0) | (b < 0)
        keys, back = np.unique(np.where(bad, 0, a * self.size + b), return_inverse=True)
        return self.stable(keys // self.size, keys % self.size)[back] & ~bad

    # --- texts -----------------------------------------------------------------
    def pieces(self, text: str) -> list[str]:
        """The words of a text, normalised; special tokens stand as themselves."""
        out = []
        for k, part in enumerate(self.special_pattern.split(text)):
            if k % 2:
                out.append(part)
            elif not COMMON.fullmatch(part):
                out += [w for w, _ in self.splitter.pre_tokenize_str(self.normalizer.normalize_str(part))]
            else:
                part = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
                out += self.pattern.findall(part)
        return out

    def prepare(self, words: list[list[str]]) -> None:
        if len(self.codes) > MEMORY_WORDS:
            self.codes, self.texts = {}, {}
        if not self.codes:
            for t, i in self.specials.items():
                self.codes[t], self.texts[t] = np.array([i], "<u4").tobytes(), t.encode()
        new = list(set().union(*words) - self.codes.keys())
        for k in range(0, len(new), 50_000):
            self.learn(new[k : k + 50_000])

    def encode(self, text: str) -> list[int]:
        words = self.pieces(text)
        self.prepare([words])
        return np.frombuffer(b"".join(map(self.codes.__getitem__, words)), "<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        return " ".join([self.names[i] for i in ids])


_codecs: dict[str, WordCodec] = {}


def codec(path: str) -> WordCodec:
    """One codec for each Python worker and file."""
    if path not in _codecs:
        _codecs[path] = WordCodec(path)
    return _codecs[path]


def text_groups(texts: pa.Array, chars: int = 250_000) -> Iterator[list[str]]:
    """The texts of a batch (null: empty) in runs of about so many characters, one text at least."""
    held, size = [], 0
    for t in texts:
        t = t.as_py() or ""
        if held and size + len(t) > chars:
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t)
    if held:
        yield held


def encode_documents(docs: DataFrame, path: str, with_ids: bool = False, with_decoded: bool = False) -> DataFrame:
    """One row for each row of ``docs`` (needs doc_id, text; other columns are not read).

    Returns doc_id, n_tokens, ids_sha256, decoded_sha256, with ``with_ids`` also ids
    array<int>, with ``with_decoded`` also decoded. A null or blank text has no tokens and
    decodes to the empty text. Repeated rows give repeated results; a null doc_id stays null.
    An empty table gives no rows. A worker holds the words of one run of texts at a time.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    schema += ", ids array<int>" * with_ids + ", decoded string" * with_decoded
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            at = 0
            for texts in text_groups(batch.column(1)):
                words = [c.pieces(t) for t in texts]
                c.prepare(words)
                codes, decoded, hashes = [], [], []
                for w in words:
                    codes.append(b"".join(map(c.codes.__getitem__, w)))
                    text = b" ".join(map(c.texts.__getitem__, w))
                    hashes.append(hashlib.sha256(text).hexdigest())
                    if with_decoded:
                        decoded.append(text.decode())
                sizes = np.fromiter(map(len, codes), np.int64, len(codes)) // 4
                out = [batch.column(0).slice(at, len(texts)), pa.array(sizes), pa.array([hashlib.sha256(x).hexdigest() for x in codes]), pa.array(hashes)]
                if with_ids:
                    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                    out.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(codes), "<i4"))))
                if with_decoded:
                    out.append(pa.array(decoded, pa.string()))
                yield pa.RecordBatch.from_arrays(out, names=names)
                at += len(texts)
        c.codes, c.texts = {}, {}  # the worker outlives the task

    small_batches(docs.sparkSession)
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, schema)
