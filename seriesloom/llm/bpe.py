"""Byte-pair encoding by speculation: longest matches first, exact merging only where a check fails.

A sequence of tokens is what the merges make of a word exactly if every token is what the merges make of its own
symbols and every two neighbours stay apart when merged alone. So the longest match proposes, all neighbouring pairs of a
batch's new words are looked up at once, pairs never seen before are merged alone, and only words with a pair that fails
are merged as a whole.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, slices

#: Fixed by the vocabulary file: how it marks a word's end, its special tokens, and its pattern of words.
WORD_END = "</w>"
#: Words (and runs of words without white space) and pairs kept from batch to batch; results do not depend on them.
MOST_WORDS = 300_000
MOST_PAIRS = 300_000
#: Bytes of text encoded at a time.
SLICE_BYTES = 1 << 20

#: str.split() divides at these too, white space of the pattern does not.
NOT_SPACE = regex.compile("[\x1c-\x1f]")
SPACES = regex.compile(r"\p{White_Space}+")


def byte_letters() -> list[str]:
    """The printable character that stands for each byte: itself if printable in Latin-1, else one from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in plain else next(others)) for b in range(256)]


class WordBpe:
    """Encoder and decoder of a byte-level BPE vocabulary with word ends (a tokenizer file's content)."""

    def __init__(self, content: str) -> None:
        spec = json.loads(content)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.ranks = {tuple(m if isinstance(m, list) else m.split(" ")): r for r, m in enumerate(model["merges"])}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in chain(self.ids.items(), self.special.items())}
        self.reach: dict[str, int] = {}  # the most symbols of a token, by its first two
        for token in self.ids:
            body = token.removesuffix(WORD_END) or token
            self.reach[body[:2]] = max(self.reach.get(body[:2], 1), len(body))
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.find = regex.compile(pattern.replace(r"\s", r"\p{White_Space}")).findall
        self.letters = byte_letters()
        self.known: dict[str, tuple[bytes, str]] = {}
        self.pairs: dict[int, bool] = {}
        self.failed = 0

    def chunks(self, text: str) -> list[str]:
        """The normalised text, divided by white space; no word of the pattern reaches over white space."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        text = text.lower()
        if NOT_SPACE.search(text):
            return [c for c in SPACES.split(text) if c]
        return text.split()

    def symbols(self, word: str) -> list[str]:
        out = [self.letters[b] for b in word.encode()]
        out[-1] += WORD_END
        return out

    def merged(self, parts: list[str]) -> list[str]:
        """The merges in the order of their rank, each at its leftmost place first."""
        if len(parts) > 64:
            return self.merged_long(parts)
        parts, rank, never = list(parts), self.ranks.get, len(self.ranks)
        ranks = [rank(pair, never) for pair in zip(parts, parts[1:])]
        while ranks and (best := min(ranks)) < never:
            at = ranks.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del ranks[at]
            if at < len(ranks):
                ranks[at] = rank((parts[at], parts[at + 1]), never)
            if at:
                ranks[at - 1] = rank((parts[at - 1], parts[at]), never)
        return parts

    def merged_long(self, parts: list[str]) -> list[str]:
        """As `merged`, with a heap of the pairs, for words in which a search for the best pair would cost too much."""
        parts, rank, n = list(parts), self.ranks, len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(rank[pair], i, *pair) for i, pair in enumerate(zip(parts, parts[1:])) if pair in rank]
        heapq.heapify(heap)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if parts[i] != left or j >= n or parts[j] != right:
                continue
            parts[i], parts[j], after[i] = left + right, "", after[j]
            if after[i] < n:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < n and (pair := (parts[k], parts[after[k]])) in rank:
                    heapq.heappush(heap, (rank[pair], k, *pair))
        return [p for p in parts if p]

    def longest_match(self, symbols: list[str]) -> list[int]:
        """Ids of the longest tokens from the left."""
        text, n, out, i, ids = "".join(symbols), len(symbols), [], 0, self.ids
        reach = self.reach
        while i < n:
            j = min(n, i + reach.get(text[i : i + 2], 1))
            while (found := ids.get(text[i:j] if j < n else text[i:])) is None and j > i + 1:
                j -= 1
            out.append(found if found is not None else -1)
            i = j
        return out

    def stays(self, left: int, right: int) -> bool:
        """Whether the merges leave these two tokens of their symbols; -1 on the left is the word's start, on the right no token."""
        if right < 0:
            return False
        tokens = [self.names[t] for t in (left, right) if t >= 0]
        return self.merged([s for t in tokens for s in self.parts(t)]) == tokens

    @staticmethod
    def parts(token: str) -> list[str]:
        body = token.removesuffix(WORD_END) if len(token) > len(WORD_END) else token
        out = list(body)
        if body != token:
            out[-1] += WORD_END
        return out

    def apart(self, lefts: np.ndarray, rights: np.ndarray) -> np.ndarray:
        """`stays` for arrays of neighbours; every distinct pair is merged once."""
        codes, where = np.unique((lefts + 1) * (1 << 32) + rights + 1, return_inverse=True)
        pairs, out = self.pairs, np.zeros(len(codes), bool)
        for i, code in enumerate(codes.tolist()):
            ok = pairs.get(code)
            if ok is None:
                ok = self.stays((code >> 32) - 1, (code & 0xFFFFFFFF) - 1)
                if len(pairs) < MOST_PAIRS:
                    pairs[code] = ok
            out[i] = ok
        return out[where]

    def learn(self, words: set[str]) -> dict[str, tuple[bytes, str]]:
        """(ids, decoded text) of words not kept yet: propose, check all neighbours of all words at once, merge the failing words."""
        new = [w for w in words if w not in self.known]
        if not new:
            return {}
        symbols = [self.symbols(w) for w in new]
        proposed = [self.longest_match(s) for s in symbols]
        starts = np.cumsum([0, *map(len, proposed)])[:-1]
        rights = np.fromiter(chain.from_iterable(proposed), np.int64)
        lefts = np.r_[np.int64(-1), rights[:-1]]
        lefts[starts] = -1  # checks that the first token is what the merges make of its own symbols
        passed = np.logical_and.reduceat(self.apart(lefts, rights), starts)
        self.failed += int((~passed).sum())
        out = {}
        for w, s, p, ok in zip(new, symbols, proposed, passed.tolist(), strict=True):
            ids = p if ok else [i for i in map(self.ids.get, self.merged(s)) if i is not None]
            out[w] = (np.array(ids, "<u4").tobytes(), " ".join([self.names[i] for i in ids]))
        self.keep(out)
        return out

    def keep(self, coded: dict[str, tuple[bytes, str]]) -> None:
        """The first ones seen are the frequent ones; the rest live for one batch."""
        self.known.update(islice(coded.items(), max(0, MOST_WORDS - len(self.known))))

    def pieces(self, text: str) -> list[str | int]:
        """Chunks and ids of special tokens, in order."""
        if self.split_special is None or "<|" not in text:
            return self.chunks(text)
        parts = self.split_special.split(text)
        return [x for i, part in enumerate(parts) for x in ([self.special[part]] if i % 2 else self.chunks(part))]

    def encode(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """(ids as little-endian 32-bit numbers, decoded text) of each text."""
        split = [self.pieces(t) for t in texts]
        seen = set().union(*split)
        new = {i: (np.array([i], "<u4").tobytes(), self.names[i]) for i in seen if isinstance(i, int)}
        # a chunk that is one word is kept once, as that word
        words = {c: self.find(c) for c in seen - new.keys() - self.known.keys()}
        new |= self.learn({c if len(found) == 1 and found[0] == c else w for c, found in words.items() for w in found})
        known = self.known
        runs = {}
        for chunk, found in words.items():
            if chunk not in new and chunk not in known:
                coded = [known.get(w) or new[w] for w in found]
                runs[chunk] = (b"".join([c[0] for c in coded]), " ".join([c[1] for c in coded if c[0]]))
        self.keep(runs)
        new |= runs
        out = []
        for chunks in split:
            found = [known.get(c) or new[c] for c in chunks]
            out.append((b"".join([f[0] for f in found]), " ".join([f[1] for f in found if f[0]])))
        return out

    def decode(self, ids: np.ndarray) -> str:
        """Token texts divided by single spaces; ids outside the vocabulary are left out."""
        return " ".join(self.names[i] for i in ids.tolist() if i in self.names)


def encode_documents(docs: DataFrame, path: str, keep_ids: bool = False) -> DataFrame:
    """Token count, checksum of the ids and of the decoded text of every document; `keep_ids` adds `ids`.

    `path` names the vocabulary on the driver; its content is broadcast (one vocabulary, whatever the table's size). Null
    texts count as empty and have no tokens; equal rows give equal rows; an empty table gives no rows. A text of one
    very long word takes one merge of the whole word if the check fails. Other columns are not read.
    """
    with open(path, encoding="utf-8") as f:
        kept = docs.sparkSession.sparkContext.broadcast({"content": f.read()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        state = kept.value  # one for each worker process, which serves many tasks
        bpe = state["bpe"] = state.get("bpe") or WordBpe(state.pop("content"))
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                coded = bpe.encode(part.column("text").to_pylist())
                decoded = [text for _, text in coded]
                columns = [
                    part.column("doc_id"), [len(ids) // 4 for ids, _ in coded], [hashlib.sha256(ids).hexdigest() for ids, _ in coded],
                    [hashlib.sha256(text.encode()).hexdigest() for text in decoded],
                ]
                yield columns + ([[np.frombuffer(ids, "<i4") for ids, _ in coded]] if keep_ids else [])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    return in_arrow(rows, run, schema, [pa.int64(), pa.int64(), pa.string(), pa.string()] + [pa.list_(pa.int32())] * keep_ids)
