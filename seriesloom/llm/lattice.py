"""All segmentations of a word into pieces of a fixed vocabulary, summed by forward and backward recursion in log space.

Words of one length are handled together as a matrix of code points: the pieces that match at every place are found by
the hash of the piece's code points, and the recursion runs over the places, for all words and all sets of piece
probabilities (one for each language) at once. A character without a piece is spelt by its byte pieces.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa

from .shingles import mix, word_hashes

START = "▁"
_STEP = np.uint64(0x9E3779B97F4A7C15)
LONG = 96
GROUP_CELLS = 2_000_000


def load_pieces(path: str) -> tuple[list[str], np.ndarray]:
    """Pieces of a sentencepiece vocabulary and the logarithms of their first probabilities, from the file's scores.

    A vocabulary made of merges has the negative rank as score; there the weight of a piece falls with its rank.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    scores = np.array([model.get_score(i) for i in range(len(pieces))])
    plain = np.array([not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)) for i in range(len(pieces))])
    ranked = plain.any() and scores[plain].min() < -1000
    logs = np.full(len(pieces), -np.log(2.0 * len(pieces)) if ranked else scores[plain].min())
    logs[plain] = -np.log(10.0 - np.maximum(scores[plain], -len(pieces) * 1.0)) if ranked else scores[plain]
    return pieces, logs - np.logaddexp.reduce(logs)


class Lattice:
    def __init__(self, pieces: list[str]) -> None:
        self.size = len(pieces)
        self.byte_ids = np.zeros(256, np.int64)
        self.end = pieces.index("</s>")
        by_length: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for i, piece in enumerate(pieces):
            if piece.startswith("<0x") and len(piece) == 6:
                self.byte_ids[int(piece[3:5], 16)] = i
            elif piece not in ("<unk>", "<s>", "</s>") and START not in piece[1:]:
                by_length[len(piece)].append((int(self._hash(self._codes([piece]))[0]), i))
        self.tables = {
            n: (np.array([h for h, _ in sorted(rows)], np.uint64), np.array([i for _, i in sorted(rows)], np.int64)) for n, rows in by_length.items()
        }
        self.reach = max(self.tables)

    @staticmethod
    def _codes(words: list[str]) -> np.ndarray:
        return np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(len(words), -1)

    @staticmethod
    def _hash(codes: np.ndarray) -> np.ndarray:
        h = np.zeros(len(codes), np.uint64)
        for k in range(codes.shape[1]):
            h = h * _STEP + codes[:, k] + np.uint64(1)
        return mix(h)

    def matches(self, codes: np.ndarray) -> list[np.ndarray]:
        """For each length l: the id of the piece of length l at each place, or -1."""
        h, out = np.zeros(codes.shape, np.uint64), []
        for n in range(1, min(self.reach, codes.shape[1]) + 1):
            h = h[:, : codes.shape[1] - n + 1] * _STEP + codes[:, n - 1 :] + np.uint64(1)
            keys, ids = self.tables.get(n, (None, None))
            if keys is None:
                out.append(np.full(h.shape, -1))
                continue
            mixed = mix(h)
            at = np.minimum(np.searchsorted(keys, mixed), len(keys) - 1)
            out.append(np.where(keys[at] == mixed, ids[at], -1))
        return out

    def _spelt(self, codes: np.ndarray, ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Rows and places of characters without a piece, and the byte pieces of each."""
        row, place = np.nonzero(ids[0] < 0)
        spell = {c: self.byte_ids[list(chr(c).encode("utf-8", "replace"))] for c in set(codes[row, place].tolist())}
        return row, place, [spell[c] for c in codes[row, place].tolist()]

    def _weights(self, codes: np.ndarray, logs: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], tuple]:
        """(ids, log weight of each match with -inf where there is none, spelt characters)."""
        ids = self.matches(codes)
        spelt = self._spelt(codes, ids)
        weights = [np.where((i >= 0)[:, :, None], logs[np.maximum(i, 0)], -np.inf) for i in ids]
        for row, place, pieces in zip(*spelt, strict=True):
            weights[0][row, place] = logs[pieces].sum(0)
        return ids, weights, spelt

    def _alpha(self, weights: list[np.ndarray], words: int, n: int, sets: int) -> np.ndarray:
        alpha = np.full((n + 1, words, sets), -np.inf)
        alpha[0] = 0.0
        for j in range(1, n + 1):
            terms = [alpha[j - k] + weights[k - 1][:, j - k] for k in range(1, min(j, len(weights)) + 1)]
            top = np.maximum.reduce(terms)
            alpha[j] = top + np.log(sum(np.exp(t - top) for t in terms))
        return alpha

    def groups(self, words: list[str]) -> list[np.ndarray]:
        """Positions of the words of one length, few enough at a time for small matrices."""
        lengths = np.array([len(w) for w in words])
        order, out = np.argsort(lengths, kind="stable"), []
        for n in np.unique(lengths):
            same = order[lengths[order] == n]
            step = max(1, GROUP_CELLS // (int(n + 1) * self.reach * 4))
            out += [same[i : i + step] for i in range(0, len(same), step)]
        return out

    def forward(self, words: list[str], logs: np.ndarray) -> np.ndarray:
        """Log probability of each word, all segmentations together, under each column of `logs`."""
        marked = [START + w for w in words]
        out = np.zeros((len(words), logs.shape[1]))
        for where in self.groups(marked) if words else []:
            codes = self._codes([marked[i] for i in where])
            if codes.shape[1] > LONG:
                for k, i in enumerate(where):
                    out[i] = self._alpha_long(codes[k : k + 1], logs)[0][-1]
                continue
            _, weights, _ = self._weights(codes, logs)
            out[where] = self._alpha(weights, len(where), codes.shape[1], logs.shape[1])[-1]
        return out

    def _alpha_long(self, codes: np.ndarray, logs: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], tuple]:
        """As `_alpha` for one long word; the loop's step covers all lengths at once."""
        ids, weights, spelt = self._weights(codes, logs)
        n, sets = codes.shape[1], logs.shape[1]
        reach = len(weights)
        table = np.full((n + 1, reach, sets), -np.inf)  # [end, length counted down to 1]
        for k in range(1, reach + 1):
            table[k:, reach - k] = weights[k - 1][0]
        alpha = np.full((n + 1 + reach, sets), -np.inf)  # shifted by reach
        alpha[reach] = 0.0
        for j in range(1, n + 1):
            terms = alpha[j : j + reach] + table[j]
            top = terms.max(0)
            alpha[j + reach] = top + np.log(np.exp(terms - top).sum(0))
        return alpha[reach:], table, ids, spelt

    def expected(self, words: list[str], counts: np.ndarray, logs: np.ndarray) -> np.ndarray:
        """How often each piece is used in the words' segmentations, weighted by their probability, under one set."""
        total = np.zeros(self.size)
        marked = [START + w for w in words]
        one = logs[:, None]
        for where in self.groups(marked) if words else []:
            codes = self._codes([marked[i] for i in where])
            n = codes.shape[1]
            ids, weights, spelt = self._weights(codes, one)
            alpha = self._alpha(weights, len(where), n, 1)[:, :, 0] if n <= LONG else self._alpha_long(codes[:1], one)[0]
            if n > LONG and len(where) > 1:
                for k in range(len(where)):
                    total += self.expected([words[where[k]]], counts[where[k : k + 1]], logs)
                continue
            alpha = alpha.reshape(n + 1, len(where))
            flipped = [w[:, ::-1] for w in weights]  # the backward recursion is the forward one of the mirrored word
            beta = (self._alpha(flipped, len(where), n, 1)[::-1, :, 0]).reshape(n + 1, len(where))
            amount = counts[where]
            for k, (i, w) in enumerate(zip(ids, weights), 1):
                use = np.exp(alpha[: n - k + 1].T + w[:, :, 0] + beta[k:].T - alpha[n][:, None]) * amount[:, None]
                found = i >= 0
                total += np.bincount(i[found], use[found], self.size)
                if k == 1:
                    for row, place, pieces in zip(*spelt, strict=True):
                        np.add.at(total, pieces, use[row, place])
        return total


class Words:
    """The words of a batch of byte texts: distinct ones, and which text holds which."""

    def __init__(self, texts: list[bytes]) -> None:
        found = [word_hashes(t) for t in texts]
        self.lengths = np.array([len(h) for h, _, _ in found], np.int64)
        hashes = np.concatenate([h for h, _, _ in found]) if found else np.zeros(0, np.uint64)
        self.hashes, first, self.which = np.unique(hashes, return_index=True, return_inverse=True)
        self.counts = np.bincount(self.which, minlength=len(self.hashes))
        self.owner = np.repeat(np.arange(len(texts)), self.lengths)
        starts = np.concatenate([s for _, s, _ in found]) if found else first
        ends = np.concatenate([e for _, _, e in found]) if found else first
        self._texts, self._owner, self._start, self._end = texts, self.owner[first], starts[first], ends[first]

    def word(self, i: int) -> bytes:
        return self._texts[self._owner[i]][self._start[i] : self._end[i]]

    def per_text(self, values: np.ndarray) -> np.ndarray:
        """Sum over each text of a value of each distinct word."""
        return np.bincount(self.owner, values[self.which], len(self.lengths)) if len(self.which) else np.zeros(len(self.lengths))


class WordScores:
    """Log probabilities of words under fixed piece probabilities; the first words seen are kept between batches, as arrays in the order of their hashes."""

    MOST = 300_000

    def __init__(self, pieces: list[str], logs: np.ndarray, fold: bool = False) -> None:
        """With `fold`, words are lower-cased by Unicode's rules first."""
        self.lattice, self.logs, self.fold = Lattice(pieces), logs, fold
        self.hashes, self.values = np.zeros(0, np.uint64), np.zeros((0, logs.shape[1]))

    def of(self, words: Words) -> np.ndarray:
        out = np.zeros((len(words.hashes), self.logs.shape[1]))
        place = np.searchsorted(self.hashes, words.hashes)
        old = np.append(self.hashes, np.uint64(0))[place] == words.hashes
        old &= place < len(self.hashes)
        out[old] = self.values[place[old]]
        new = np.flatnonzero(~old)
        if len(new):
            named = [words.word(i).decode("utf-8", "replace") for i in new.tolist()]
            out[new] = self.lattice.forward([w.lower() for w in named] if self.fold else named, self.logs)
            kept = new[: max(0, self.MOST - len(self.hashes))]
            self.hashes = np.insert(self.hashes, place[kept], words.hashes[kept])
            self.values = np.insert(self.values, place[kept], out[kept], axis=0)
        return out


def texts_of(batch: pa.RecordBatch, column: str) -> list[bytes]:
    return [t or b"" for t in batch.column(column).to_pylist()]
