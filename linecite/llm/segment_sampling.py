"""SentencePiece encoding and decoding with sampled segmentations, by Gumbel top-k.

A text's segmentations into vocabulary pieces are the paths of a lattice. ``encode`` draws ``k``
different paths without replacement: each path's log-probability is perturbed by Gumbel noise, and the
``k`` largest are found by A-star search from the whole lattice down. A node of the search is a set of
paths; its value is the largest perturbed score in the set, which bounds every part of it, so the
first ``k`` sets that shrink to single paths are the sample. A set is split lazily: one path is drawn
from it, and for each step the paths that leave there stay as one set, whose value is drawn from a
Gumbel distribution truncated at its parent's.

Pieces do not cross from other characters to a space, so lattices are those of words with their
spaces; backward sums turn piece scores into step probabilities. Words of many rows are handled
together: each distinct word is compiled once, all words advance step by step. Random numbers are
hashes of the row key, the sample, the word and the step, so a row's sample does not depend on the
rows around it.

A BPE vocabulary has ranks, not probabilities: a piece of rank r gets a share in proportion to
``1 / (r + 10)``, to the power of ``alpha``. Characters outside the vocabulary are spelled in byte pieces, as is the mark that
stands for a space; decoding is exact. Null and empty texts have one segmentation, without pieces. A
text with fewer than ``k`` segmentations yields all of them. Rows are handled one by one: repeated rows
give repeated results, null keys share a seed, further columns are ignored. Memory in a task
follows a batch of ``SLICE_CHARS`` characters, or the longest text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linecite.llm.common import prepare, slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SAMPLES = 2
SLICE_CHARS = 1_000_000
#: Log-probabilities of pieces are multiplied by this; smaller values even out the sample.
ALPHA = 0.2
_U = np.uint64
_ALL = (1 << 64) - 1


def _mixed(x: np.ndarray) -> np.ndarray:
    """A hash of 64-bit numbers (splitmix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _uniform(x: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) from hashes."""
    return ((_mixed(x) >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53


class Vocabulary:
    """Pieces as a trie over characters, with log-probabilities."""

    def __init__(self, model: str, alpha: float):
        loaded = sentencepiece.SentencePieceProcessor(model_file=model)
        raws: list[bytes] = []
        self.byte_ids = np.zeros(256, np.int32)
        pieces: dict[str, int] = {}
        ranks = np.zeros(loaded.vocab_size())
        for i in range(loaded.vocab_size()):
            piece, raw = loaded.id_to_piece(i), b""
            if loaded.is_byte(i):
                raw = bytes([int(piece[1:-1], 16)])
                self.byte_ids[raw[0]] = i
            elif not (loaded.is_control(i) or loaded.is_unknown(i) or loaded.is_unused(i)):
                spelled = piece.replace("▁", " ")
                raw = spelled.encode("utf-8")
                pieces[spelled] = i
            raws.append(raw)
            ranks[i] = i
        #: The bytes of each piece.
        self.bytes = np.empty(len(raws), object)
        self.bytes[:] = raws
        share = 1.0 / (ranks + 10.0)
        self.logp = alpha * np.log(share / share.sum())
        self.byte_logp = float(self.logp.min())
        if any(" " in p.lstrip(" ") for p in pieces):
            raise ValueError("pieces that go on behind a space are not supported")
        alone = "" if any("\n" in p and len(p) > 1 for p in pieces) else r"\n"
        self.words = re.compile(rf"{alone + '|' if alone else ''} *[^ {alone}]+| +")
        self._build(pieces)

    def _build(self, pieces: dict[str, int]) -> None:
        children: dict[tuple[int, str], int] = {}
        ends = {0: -1}
        for piece, i in pieces.items():
            node = 0
            for c in piece:
                node = children.setdefault((node, c), len(children) + 1)
                ends.setdefault(node, -1)
            ends[node] = i
        self.piece_at = np.array([ends[n] for n in range(len(ends))], np.int64)
        self.mask = (1 << (len(children) * 4).bit_length()) - 1
        self.keys = np.full(self.mask + 1, -1, np.int64)
        self.values = np.zeros(self.mask + 1, np.int64)
        for (node, c), child in children.items():
            key = (node << 21) | ord(c)
            slot = int(self._slot(np.array([key]))[0])
            while self.keys[slot] >= 0:
                slot = (slot + 1) & self.mask
            self.keys[slot], self.values[slot] = key, child

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _U(0x9E3779B97F4A7C15)) >> _U(30)).astype(np.int64) & self.mask

    def step(self, nodes: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """The child of each node by each character, -1 where there is none."""
        keys = (nodes << 21) | chars
        slots = self._slot(keys)
        found = self.keys[slots]
        result = np.where(found == keys, self.values[slots], -1)
        open_ = np.flatnonzero((found != keys) & (found >= 0))
        while len(open_):
            slots[open_] = (slots[open_] + 1) & self.mask
            found = self.keys[slots[open_]]
            hit = found == keys[open_]
            result[open_[hit]] = self.values[slots[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return result


@lru_cache(maxsize=2)
def vocabulary(model: str, alpha: float) -> Vocabulary:
    return Vocabulary(model, alpha)


class Lattice:
    """The lattices of distinct words, one state per character and one at each end."""

    def __init__(self, vocab: Vocabulary, words: list[str]):
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        word_of = np.repeat(np.arange(len(words)), sizes)
        firsts = np.cumsum(sizes) - sizes
        #: State of each word's first character; a word has as many states as characters and one more.
        self.first = firsts + np.arange(len(words))
        state = np.arange(len(chars)) + word_of
        left = np.repeat(firsts + sizes, sizes) - np.arange(len(chars))

        at = np.arange(len(chars))
        nodes = np.zeros(len(chars), np.int64)
        counts = np.zeros(len(chars), np.int32)  # edges per character so far
        found = []
        length = 0
        while len(at):
            nodes = vocab.step(nodes, chars[at + length])
            length += 1
            alive = nodes >= 0
            at, nodes = at[alive], nodes[alive]
            piece = vocab.piece_at[nodes]
            whole = piece >= 0
            begin = at[whole]
            found.append((begin, length, piece[whole], counts[begin]))
            counts[begin] += 1
            if length == 1:  # characters that are no piece are spelled in bytes
                rest = np.ones(len(chars), bool)
                rest[begin] = False
                begin = np.flatnonzero(rest)
                found.append((begin, 1, -1 - chars[begin], counts[begin]))
                counts[begin] += 1
            more = left[at] > length
            at, nodes = at[more], nodes[more]
        at_edge = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
        n_edges = int(at_edge[-1])
        size, self.piece = (np.empty(n_edges, np.int64) for _ in range(2))
        for begin, length_, piece, rank in found:
            place = at_edge[begin + 1] - 1 - rank  # longest first
            size[place], self.piece[place] = length_, piece

        #: Ids per edge: one, or the bytes of a character.
        self.n_ids = np.ones(n_edges, np.int64)
        logp = vocab.logp[np.maximum(self.piece, 0)]
        spelled_out = np.flatnonzero(self.piece < 0)
        code = -1 - self.piece[spelled_out]
        self.n_ids[spelled_out] += (code >= 0x80).astype(np.int64) + (code >= 0x800) + (code >= 0x10000)
        logp[spelled_out] = vocab.byte_logp * self.n_ids[spelled_out]
        self.id_at = np.cumsum(self.n_ids) - self.n_ids
        self.ids = np.repeat(self.piece, self.n_ids).astype(np.int32)
        for edge, own in zip(spelled_out.tolist(), code.tolist()):
            spelled = chr(own).encode("utf-8", "surrogatepass")
            first = self.id_at[edge]
            self.ids[first : first + len(spelled)] = vocab.byte_ids[np.frombuffer(spelled, np.uint8)]
        self.next = np.repeat(state, counts) + size
        n_states = len(chars) + len(words)
        # From the ends of the words backwards: the log of the summed probabilities of all rests.
        beta = np.zeros(n_states)
        longest = int(left.max(initial=0))
        small = left.astype(np.int16) if longest < 1 << 15 else left
        by_left = np.argsort(small, kind="stable")
        bounds = np.concatenate([[0], np.cumsum(np.bincount(left, minlength=longest + 1))])
        scores = np.empty(n_edges)
        for r in range(1, longest + 1):
            own = by_left[bounds[r] : bounds[r + 1]]
            if not len(own):
                continue
            n = counts[own]
            heads = np.cumsum(n) - n
            edges = np.repeat(at_edge[own] - heads, n) + np.arange(int(n.sum()))
            value = logp[edges] + beta[self.next[edges]]
            top = np.maximum.reduceat(value, heads)
            total = np.log(np.add.reduceat(np.exp(value - np.repeat(top, n)), heads)) + top
            beta[state[own]] = total
            scores[edges] = value - np.repeat(total, n)
        #: Log-probability of each edge given its state; edges of a state are neighbours.
        self.logq = scores
        self.q = np.exp(scores)
        per_state = np.zeros(n_states, np.int64)
        per_state[state] = counts
        self.edges = np.concatenate([[0], np.cumsum(per_state)])

    def ids_of(self, edges: np.ndarray) -> np.ndarray:
        """The piece ids along a path."""
        n = self.n_ids[edges]
        total = int(n.sum())
        if total == len(edges):
            return self.ids[self.id_at[edges]]
        return self.ids[np.repeat(self.id_at[edges] - (np.cumsum(n) - n), n) + np.arange(total)]

    def walk(self, states: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Draw a path from each state to its word's end: the edges of all paths, and their counts."""
        counts = np.zeros(len(states), np.int64)
        who, now, steps = np.arange(len(states)), states, []
        open_ = self.edges[now + 1] > self.edges[now]
        who, now = who[open_], now[open_]
        t = 0
        while len(who):
            u = _uniform(keys[who] + _U(t * 0xD1342543DE82EF95 & _ALL))
            edge = self.edges[now].copy()
            last = self.edges[now + 1] - 1
            active = np.arange(len(now))
            while len(active):
                u[active] -= self.q[edge[active]]
                active = active[(u[active] >= 0) & (edge[active] < last[active])]
                edge[active] += 1
            steps.append((who, edge))
            counts[who] += 1
            now = self.next[edge]
            open_ = self.edges[now + 1] > self.edges[now]
            who, now = who[open_], now[open_]
            t += 1
        path = np.empty(int(counts.sum()), np.int64)
        offsets = np.cumsum(counts) - counts
        for i, (who, edge) in enumerate(steps):
            path[offsets[who] + i] = edge
        return path, counts


#: No Gumbel number here exceeds its location by more: uniform numbers have 53 bits.
_MOST = 38.0
_STRIDE = 64


class _Path:
    """A drawn path, and the sets of paths that leave it at its steps.

    The value of such a set is drawn when it is needed. Locations fall along the path, so steps too
    far down to hold the largest value are not looked at.
    """

    def __init__(self, lattice: Lattice, edges: np.ndarray, value: float, salt, fresh: int):
        self.lattice, self.edges, self.value, self.salt = lattice, edges, value, salt
        logq = lattice.logq[edges]
        self.total = float(logq.sum())
        #: Values of the sets at the steps before ``seen``; steps before ``fresh`` are another path's.
        self.seen = fresh
        self.rest = np.full(fresh, -np.inf)
        self.before = float(logq[:fresh].sum())
        self.taken: dict[int, list[int]] = {}

    def best(self, least: float) -> tuple[float, int]:
        """The largest value and its step, if it is above ``least``."""
        top = float(self.rest.max(initial=-np.inf))
        while self.seen < len(self.edges) and self.before + _MOST > max(top, least):
            steps = np.arange(self.seen, min(self.seen + _STRIDE, len(self.edges)))
            logq = self.lattice.logq[self.edges[steps]]
            ends = self.before + np.cumsum(logq)
            left = np.clip(-np.expm1(logq), 0.0, 1.0)
            values = np.full(len(steps), -np.inf)
            open_ = np.flatnonzero(left > 1e-12)
            location = (ends - logq)[open_] + np.log(left[open_])
            values[open_] = truncated_gumbel(location, self.value, self.salt, steps[open_])
            self.rest = np.concatenate([self.rest, values])
            self.seen, self.before = int(steps[-1]) + 1, float(ends[-1])
            top = max(top, float(values.max()))
        return top, int(np.argmax(self.rest)) if top > -np.inf else -1


def truncated_gumbel(location: np.ndarray, top: float, salt, numbers: np.ndarray) -> np.ndarray:
    """Gumbel numbers at the locations, given that they are at most ``top``."""
    u = _uniform(numbers.astype(np.uint64) * _U(0xA0761D6478BD642F) ^ salt)
    return location - np.log(np.exp(np.minimum(location - top, 700.0)) - np.log(u))


class _Index(dict):
    """Numbers words in the order in which they come."""

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        return number


@dataclass(frozen=True)
class Segmentation:
    ids: np.ndarray
    log_prob: float
    log_inclusion: float


class Sampler:
    def __init__(self, model: str = MODEL, samples: int = SAMPLES, alpha: float = ALPHA):
        self.vocab = vocabulary(model, alpha)
        self.samples = samples

    def encode(self, texts: list[str | None], keys: list[str]) -> list[list[Segmentation]]:
        """``samples`` different segmentations of each text, the largest perturbed score first."""
        vocab, index = self.vocab, _Index()
        ids_of: list[int] = []
        bounds = [0]
        for text in texts:
            if text:
                ids_of.extend(map(index.__getitem__, vocab.words.findall(" " + text)))
            bounds.append(len(ids_of))
        word_ids = np.array(ids_of, np.int64)
        del ids_of
        lattice = Lattice(vocab, list(index))
        states = lattice.first[word_ids]
        seeds = [xxhash.xxh64_intdigest(k, 7) for k in keys]
        rows = [i for i in range(len(texts)) if bounds[i + 1] > bounds[i]]
        paths: dict[int, list[_Path]] = {i: [] for i in rows}
        # The root set holds all paths; its value is an untruncated Gumbel number.
        roots = -np.log(-np.log(_uniform(np.array(seeds, np.uint64) ^ _U(0xA5A5))))
        pending = {i: (float(roots[i]), None, 0) for i in rows}
        for j in range(self.samples):
            self._draw(lattice, states, bounds, seeds, j, pending, paths)
            pending = {i: s for i in pending if (s := self._best(paths[i])) is not None}
        results = [[Segmentation(np.zeros(0, np.int32), 0.0, 0.0)] for _ in texts]
        for i in rows:
            results[i] = []
            for path in paths[i]:
                # The chance that the noise lifts this path over the best one left out.
                x = path.total - pending[i][0] if i in pending else np.inf
                inclusion = 0.0 if x > 50 else (np.log(-np.expm1(-np.exp(x))) if x > -30 else x)
                ids = lattice.ids_of(path.edges)
                results[i].append(Segmentation(ids, path.total, float(inclusion)))
        return results

    def _draw(self, lattice, states, bounds, seeds, j, pending, paths) -> None:
        """Draw one path from each pending set, of all rows together."""
        if not pending:
            return
        rows = list(pending)
        salts = _mixed(
            np.array([seeds[i] for i in rows], np.uint64) ^ _U((j + 1) * 0x9E3779B97F4A7C15 & _ALL)
        )
        edges: list[int | None] = []
        blocks, firsts, sizes = [], [], []
        for i, salt in zip(rows, salts):
            _, parent, at = pending[i]
            own = states[bounds[i] : bounds[i + 1]]
            edge, word = None, 0
            if parent is not None:
                # Behind the other edge: the rest of its word, then all further words.
                edge = self._leave(lattice, parent, at, salt)
                word = self._word(lattice, parent, at)
                own = own[word:].copy()
                own[0] = lattice.next[edge]
            edges.append(edge)
            blocks.append(own)
            firsts.append(word)
            sizes.append(len(own))
        ends = np.cumsum(sizes)
        numbers = np.arange(int(ends[-1])) - np.repeat(ends - sizes - firsts, sizes)
        keys = _mixed(numbers.astype(np.uint64) * _U(0xC2B2AE3D27D4EB4F) + np.repeat(salts, sizes))
        path, counts = lattice.walk(np.concatenate(blocks), keys)
        ends_at = np.concatenate([[0], np.cumsum(counts)])[np.concatenate([[0], ends])]
        for n, i in enumerate(rows):
            value, parent, at = pending[i]
            own = path[ends_at[n] : ends_at[n + 1]]
            if parent is None:
                paths[i].append(_Path(lattice, own, value, salts[n], 0))
                continue
            own = np.concatenate([parent.edges[:at], [edges[n]], own])
            paths[i].append(_Path(lattice, own, value, salts[n], at + 1))
            # What remains of the split set stays with its parent, below the drawn value.
            gone = parent.taken.setdefault(at, [int(parent.edges[at])])
            gone.append(edges[n])
            parent.rest[at] = -np.inf
            mass = 1.0 - lattice.q[gone].sum()
            if mass > 1e-12 and len(gone) < len(self._state_edges(lattice, parent.edges[at])):
                location = float(lattice.logq[parent.edges[:at]].sum()) + np.log(mass)
                number = np.array([at + (1 << 40)])
                parent.rest[at] = truncated_gumbel(np.array([location]), value, salts[n], number)[0]

    @staticmethod
    def _word(lattice: Lattice, path: _Path, at: int) -> int:
        """The number of the word that a step is in: words that ended before it."""
        after = lattice.next[path.edges[:at]]
        return int((lattice.edges[after + 1] == lattice.edges[after]).sum())

    @staticmethod
    def _state_edges(lattice: Lattice, edge: int) -> np.ndarray:
        state = np.searchsorted(lattice.edges, edge, side="right") - 1
        return np.arange(lattice.edges[state], lattice.edges[state + 1])

    def _leave(self, lattice: Lattice, parent: _Path, at: int, salt) -> int:
        """Another edge at a step of a path, by the probabilities of those not taken."""
        gone = parent.taken.get(at, [int(parent.edges[at])])
        choices = np.setdiff1d(self._state_edges(lattice, parent.edges[at]), gone)
        sums = np.cumsum(lattice.q[choices])
        u = _uniform(np.array([at], np.uint64) * _U(0xE7037ED1A0B428DB) ^ salt)[0]
        return int(choices[min(np.searchsorted(sums, u * sums[-1], side="right"), len(choices) - 1)])

    @staticmethod
    def _best(paths: list[_Path]):
        """The open set of the largest value: ``value, path, step``; None if all paths are drawn."""
        best = None
        for path in paths:
            value, at = path.best(-np.inf if best is None else best[0])
            if value > (-np.inf if best is None else best[0]):
                best = (value, path, at)
        return best

    def decode(self, ids) -> str:
        """The text of a row of pieces; bytes that are no text become replacement characters."""
        joined = b"".join(self.vocab.bytes[np.asarray(ids, np.int64)].tolist())
        return joined[1:].decode("utf-8", "replace") if joined[:1] == b" " else joined.decode("utf-8", "replace")


def _text_slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, text in enumerate(texts):
        if i > start and size + len(text or "") > SLICE_CHARS:
            yield start, i
            start, size = i, 0
        size += len(text or "")
    if start < len(texts):
        yield start, len(texts)


def encode_samples(
    docs: DataFrame, samples: int = SAMPLES, model: str = MODEL, alpha: float = ALPHA
) -> DataFrame:
    """One row per sampled segmentation of each row of ``docs(doc_id, text)``.

    ``doc_id, sample`` (from 1), ``ids``, ``n_ids``, ``log_prob``, ``log_inclusion`` (log of the chance
    to be among the sample) and ``round_trip``, whether decoding gives the text back.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(model, samples, alpha)
        for batch in slices(batches):
            all_texts = batch.column("text").to_pylist()
            all_keys = batch.column("doc_id").to_pylist()
            for a, b in _text_slices(all_texts):
                texts, keys = all_texts[a:b], all_keys[a:b]
                found = sampler.encode(texts, [str(k) for k in keys])
                flat = [(k, j + 1, s, t) for k, t, one in zip(keys, texts, found) for j, s in enumerate(one)]
                ids = [s.ids for _, _, s, _ in flat]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                values = np.concatenate(ids) if ids else np.zeros(0, np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([k for k, *_ in flat], pa.int64()),
                        pa.array([j for _, j, *_ in flat], pa.int32()),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)),
                        pa.array([len(x) for x in ids], pa.int32()),
                        pa.array([s.log_prob for *_, s, _ in flat], pa.float64()),
                        pa.array([s.log_inclusion for *_, s, _ in flat], pa.float64()),
                        pa.array([sampler.decode(s.ids) == (t or "") for *_, s, t in flat], pa.bool_()),
                    ],
                    ["doc_id", "sample", "ids", "n_ids", "log_prob", "log_inclusion", "round_trip"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(
        run,
        "doc_id long, sample int, ids array<int>, n_ids int, log_prob double, "
        "log_inclusion double, round_trip boolean",
    )


def decode_samples(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """``doc_id, sample, text`` from ``doc_id, sample, ids``; null ids give a null text."""
    prepare(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(model)
        for batch in batches:
            texts = [None if ids is None else sampler.decode(ids) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("sample"), pa.array(texts, pa.string())],
                ["doc_id", "sample", "text"],
            )

    return encoded.select("doc_id", "sample", "ids").mapInArrow(
        run, "doc_id long, sample int, text string"
    )
