"""SentencePiece encoding and decoding with N-best segmentations.

A text becomes a lattice whose edges are vocabulary pieces, each with its score; characters without a
piece fall back to one edge of UTF-8 byte pieces. Forward Viterbi gives the best score from the start
to every position. Those scores are exact heuristics for a backward A-star search from the end, so the
search pops complete segmentations in falling order of total score and expands nothing else.

Every entry of the agenda stands for at least one complete segmentation of exactly its own priority, so
only the N smallest entries can still matter and the agenda never holds more.

No piece continues over a space mark that follows another character, so the lattice of a text is a
chain of independent word lattices; a distinct word is searched once while it is in the task's memo
(bounded in bytes) and the N best of a text are the N best combinations of its words' lists, which is
exactly what a search over the undivided lattice returns. A vocabulary with pieces that do cross turns
the division off. Words become numbers with one look-up each; everything per text after that is arithmetic
on flat arrays.

Edge cases: null is encoded as empty; an empty text has one segmentation without pieces and score 0.
Equal scores prefer the segmentation found first from the left. Literal space marks (U+2581) in a text
decode to spaces, as in the library, so ``round_trip`` is false for such texts; bytes that are not UTF-8
count as U+FFFD. A very long text is encoded whole: it is divided a megabyte at a time and takes memory in
proportion to its own length. Rows may repeat; extra columns, whatever their names, are ignored. An empty
table gives an empty result.
"""

from __future__ import annotations

import math
from array import array
from bisect import insort
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import nsmallest
from itertools import repeat

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MARK = "▁"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"


@dataclass
class Vocabulary:
    """Normal pieces with their scores, the ids of byte pieces, and the id of the unknown piece."""

    pieces: list[str]
    scores: dict[str, tuple[int, float]]
    byte_ids: list[int] | None
    unk: int
    longest: int
    penalty: float
    dummy_prefix: bool
    splits: bool
    newline_alone: bool


def load(path: str = MODEL) -> Vocabulary:
    """Read a model file on the driver; the vocabulary (bounded by the model) is shipped to tasks."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
    normal = {p: (i, float(sp.get_score(i))) for i, p in enumerate(pieces) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}
    by_byte = {int(p[3:5], 16): i for i, p in enumerate(pieces) if sp.is_byte(i)}
    crossing = any(MARK in p.lstrip(MARK) for p in normal)
    return Vocabulary(
        pieces, normal, [by_byte[b] for b in range(256)] if len(by_byte) == 256 else None, sp.unk_id(), max(map(len, normal)), min(s for _, s in normal.values()) - 10.0,
        sp.encode("a", out_type=str)[0].startswith(MARK), not crossing, not any("\n" in p for p in normal),
    )


class Lattice:
    """Segmentations of one string."""

    def __init__(self, v: Vocabulary):
        self.v = v
        self.singles = {p for p in v.scores if len(p) == 1}
        #: All pieces that end at each position of a string, in one pass over it.
        self.automaton = ahocorasick.Automaton()
        for p, (i, score) in v.scores.items():
            self.automaton.add_word(p, (len(p), (i,), score))
        self.automaton.make_automaton()

    def fallback(self, ch: str) -> tuple[int, tuple[int, ...], float]:
        v = self.v
        return 1, (tuple(v.byte_ids[b] for b in ch.encode("utf-8", "surrogatepass")) if v.byte_ids else (v.unk,)), v.penalty

    def forward(self, s: str) -> tuple[list[float], list[list[tuple]]]:
        """Best score from the start to every position, and the edges (length, ids, score) into each."""
        n = len(s)
        into: list[list] = [[] for _ in range(n + 1)]
        best = [0.0] + [-math.inf] * n
        if self.singles.issuperset(s):
            # pieces come by their ends, so every start has its final score already
            for at, edge in self.automaton.iter(s):
                end = at + 1
                into[end].append(edge)
                through = best[end - edge[0]] + edge[2]
                if through > best[end]:
                    best[end] = through
            return best, into
        for at, edge in self.automaton.iter(s):
            into[at + 1].append(edge)
        for i, ch in enumerate(s):
            if ch not in self.singles:
                into[i + 1].append(self.fallback(ch))
            best[i + 1] = max([best[i + 1 - length] + score for length, _, score in into[i + 1]])
        return best, into

    def nbest(self, s: str, n: int) -> list[tuple[float, list[int]]]:
        """The n best (score, ids), best first."""
        forward, into = self.forward(s)
        # agenda of (-(score so far + best prefix score), position, order, score so far, ids to the right);
        # of equal ones the nearest to the start goes first, so ties are not all explored side by side
        agenda, order, out = [(-forward[-1], len(s), 0, 0.0, None)], 0, []
        while agenda and len(out) < n:
            _, at, _, done, right = agenda.pop(0)
            if at == 0:
                ids: list[int] = []
                while right:
                    ids.extend(right[0])
                    right = right[1]
                out.append((done, ids))
                continue
            room = n - len(out)
            for length, piece, score in into[at]:
                start, total = at - length, done + score
                least = -(forward[start] + total)
                if len(agenda) == room:
                    last = agenda[-1]
                    if least > last[0] or least == last[0] and start >= last[1]:
                        continue
                    agenda.pop()
                order += 1
                insort(agenda, (least, start, order, total, (piece, right)))
        return out


def ragged(starts: np.ndarray, flat: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of the rows ``which`` of a flat array one after another, and their lengths."""
    lengths = starts[which + 1] - starts[which]
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.arange(total) + np.repeat(starts[which] - ends + lengths, lengths)], lengths


class ManyLattices:
    """The same search as ``Lattice.nbest`` for many short strings at once, in lock step on arrays.

    All strings lie in one text, each followed by a character that no piece holds, so a position of the
    text is a node. Every position walks a trie of the pieces, all of them one character at a time: the trie
    is a hash table from (trie node, character) to the next trie node. Each round of the search pops the
    first entry of every agenda, expands it and keeps the N smallest entries of each.
    """

    def __init__(self, lattice: Lattice):
        v = self.v = lattice.v
        self.lattice = lattice
        pieces = list(v.scores)
        self.lengths = np.array([len(p) for p in pieces], np.int64)
        self.ids = np.array([v.scores[p][0] for p in pieces], np.int64)
        self.scores = np.array([v.scores[p][1] for p in pieces])
        step: dict[int, int] = {}
        ends = [-1]
        for k, p in enumerate(pieces):
            at = 0
            for c in p:
                if (key := at << 21 | ord(c)) not in step:
                    step[key] = len(ends)
                    ends.append(-1)
                at = step[key]
            ends[at] = k
        #: The piece that ends in each trie node, or -1.
        self.piece_at = np.array(ends, np.int64)
        self.bits = max(10, (8 * len(step)).bit_length())
        self.keys, self.next = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32)
        keys, to = np.array(list(step), np.int64), np.array(list(step.values()), np.int32)
        slots = self.slot(keys)
        while len(keys):
            free = self.keys[slots] < 0
            _, one = np.unique(np.where(free, slots, -1), return_index=True)
            one = one[free[one]]
            self.keys[slots[one]], self.next[slots[one]] = keys[one], to[one]
            left = np.ones(len(keys), bool)
            left[one] = False
            keys, to, slots = keys[left], to[left], (slots[left] + 1) & ((1 << self.bits) - 1)
        used = set("".join(pieces))
        self.stop = next(c for c in map(chr, range(0xFDD0, 0x110000)) if c not in used)
        self.singles = np.sort(np.array([ord(c) for c in lattice.singles], np.int64))

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def walk(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(end, piece) of every piece that occurs in a text."""
        at, state, length, ends, pieces = np.arange(len(codes)), np.zeros(len(codes), np.int64), 0, [], []
        while len(at):
            keys = state << 21 | codes[at + length]
            slots = self.slot(keys)
            there = self.keys[slots]
            other = np.flatnonzero((there != keys) & (there >= 0))
            while len(other):  # the slot is another key's: look at the next one
                slots[other] = (slots[other] + 1) & ((1 << self.bits) - 1)
                there[other] = self.keys[slots[other]]
                other = other[(there[other] != keys[other]) & (there[other] >= 0)]
            hit = there == keys
            at, state, length = at[hit], self.next[slots[hit]].astype(np.int64), length + 1
            piece = self.piece_at[state]
            whole = piece >= 0
            ends.append(at[whole] + length)
            pieces.append(piece[whole])
        return np.concatenate([*ends, np.zeros(0, np.int64)]), np.concatenate([*pieces, np.zeros(0, np.int64)])

    def edges(self, strings: list[str]) -> None:
        """Fill the nodes and the edges, sorted by the node that they lead to."""
        text = self.stop.join([*strings, ""])
        self.size = np.array([len(x) for x in strings], np.int64)
        self.first = np.r_[0, np.cumsum(self.size + 1)]
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        end, piece = self.walk(codes)
        known = self.singles[np.searchsorted(self.singles, codes).clip(max=len(self.singles) - 1)] == codes if len(self.singles) else np.zeros(len(codes), bool)
        known[self.first[1:] - 1] = True
        strange, which = np.unique(codes[~known], return_inverse=True)
        fallback = [self.lattice.fallback(chr(c)) for c in strange.tolist()]
        # pieces of one id each, then the fallbacks of the strange characters
        k = len(self.ids)
        self.row_ids = np.r_[self.ids, np.array([i for _, ids, _ in fallback for i in ids], np.int64)]
        self.row_starts = np.r_[np.arange(k + 1), k + np.cumsum([len(ids) for _, ids, _ in fallback], dtype=np.int64)]
        length, score = np.r_[self.lengths, np.ones(len(strange), np.int64)], np.r_[self.scores, np.full(len(strange), self.v.penalty)]
        if len(strange):
            end, piece = np.r_[end, np.flatnonzero(~known) + 1], np.r_[piece, k + which]
        order = np.argsort(end, kind="stable")
        end, piece = end[order], piece[order]
        self.end, self.piece = end, piece
        self.start, self.score = end - length[piece], score[piece]
        self.into = np.searchsorted(end, np.arange(len(codes) + 2))

    def forward(self) -> np.ndarray:
        """The best score from the start of its string to every node, one position of all strings at a time."""
        best = np.full(int(self.first[-1]) + 1, -np.inf)
        best[self.first] = 0
        place = self.end - np.repeat(self.first[:-1], self.size + 1)[self.end]
        order = np.argsort(place.astype(np.uint16) if len(place) and place.max() < 1 << 16 else place, kind="stable")
        end, start, score = self.end[order], self.start[order], self.score[order]
        heads = np.flatnonzero(np.r_[True, end[1:] != end[:-1]]) if len(end) else np.zeros(0, np.int64)
        levels = np.searchsorted(place[order], np.arange(1, int(self.size.max(initial=0)) + 2))
        groups = np.searchsorted(heads, levels)
        for e0, e1, g0, g1 in zip(levels, levels[1:], groups, groups[1:], strict=False):
            if e1 > e0:
                best[end[heads[g0:g1]]] = np.maximum.reduceat(best[start[e0:e1]] + score[e0:e1], heads[g0:g1] - e0)
        return best

    def __call__(self, strings: list[str], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The N best of all strings, best first: the string and score of each, and its ids as starts and flat."""
        self.edges(strings)
        best, m = self.forward(), len(strings)
        least, node, done, path = np.full((m, n), np.inf), np.zeros((m, n), np.int64), np.zeros((m, n)), np.full((m, n), -1, np.int64)
        node[:, 0] = self.first[:-1] + self.size
        least[:, 0] = -best[node[:, 0]]
        count = np.zeros(m, np.int64)
        edge_of, parent_of, made = [], [], 0
        out_string, out_score, out_path = [], [], []
        active, every = np.arange(m), np.arange(len(self.end))
        while len(active):
            at, so_far, right = node[active, 0], done[active, 0], path[active, 0]
            ended = at == self.first[active]
            over = active[ended]
            for table, empty in ((least, np.inf), (node, 0), (done, 0), (path, -1)):
                table[over, :-1] = table[over, 1:]
                table[over, -1] = empty
            out_string.append(over)
            out_score.append(so_far[ended])
            out_path.append(right[ended])
            count[over] += 1
            grow = np.flatnonzero(~ended)
            edges, number = ragged(self.into, every, at[grow])
            whose = np.repeat(grow, number)
            total = so_far[whose] + self.score[edges]
            ahead = -(best[self.start[edges]] + total)
            if n == 2 and len(edges) and number.all():
                # of a word's new entries only the two first can stay, or one if one has come out already
                heads = np.r_[0, np.cumsum(number[:-1])]
                bound = np.minimum.reduceat(ahead, heads)
                second = np.minimum.reduceat(np.where(ahead > np.repeat(bound, number), ahead, np.inf), heads)
                some = ahead <= np.repeat(np.where(count[active[grow]] == 0, second, bound), number)
                edges, whose, total, ahead = edges[some], whose[some], total[some], ahead[some]
            # entries that wait go before new ones of the same priority and place
            old, column = np.nonzero(np.isfinite(least[active[grow], 1:]))
            old, column = active[grow][old], column + 1
            word = np.r_[old, active[whose]]
            priority = np.r_[least[old, column], ahead]
            place = np.r_[node[old, column], self.start[edges]]
            sums = np.r_[done[old, column], total]
            refs = np.r_[path[old, column], made + np.arange(len(edges))]
            edge_of.append(edges)
            parent_of.append(right[whose])
            made += len(edges)
            order = np.lexsort((place, priority, word))
            word = word[order]
            heads = np.flatnonzero(np.r_[True, word[1:] != word[:-1]]) if len(word) else np.zeros(0, np.int64)
            rank = np.arange(len(word)) - np.repeat(heads, np.diff(np.r_[heads, len(word)]))
            keep = rank < n - count[word]
            word, rank, order = word[keep], rank[keep], order[keep]
            least[active[grow]] = np.inf
            least[word, rank], node[word, rank], done[word, rank], path[word, rank] = priority[order], place[order], sums[order], refs[order]
            active = active[(count[active] < n) & np.isfinite(least[active, 0])]
        string, score, at = np.concatenate(out_string), np.concatenate(out_score), np.concatenate(out_path)
        order = np.argsort(string, kind="stable")
        string, score, at = string[order], score[order], at[order]
        edge_of, parent_of = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (edge_of, parent_of))
        steps, rows, row = [], [], np.arange(len(at))
        while len(row):
            row, at = row[at >= 0], at[at >= 0]
            rows.append(row)
            steps.append(edge_of[at])
            at = parent_of[at]
        rows, steps = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rows, steps))
        steps = steps[np.argsort(rows, kind="stable")]
        ids, number = ragged(self.row_starts, self.row_ids, self.piece[steps])
        per_row = np.bincount(np.repeat(np.sort(rows), number), minlength=len(string))
        return string, score, np.r_[0, np.cumsum(per_row)], ids.astype(np.int32)


class Memo(dict):
    """Words (bytes) to their numbers; per number, in flat arrays that only grow at their ends: the best
    score and ids, and the other segmentations as losses against the best and ids."""

    #: Longer words are searched one by one, as lock step would wait for them.
    SHORT = 64

    def __init__(self, lattice: Lattice, n: int):
        self.lattice, self.many, self.n = lattice, ManyLattices(lattice), n
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.scores, self.first_loss = array("d"), array("d")
        self.starts, self.ids = array("q", [0]), array("i")
        self.other_starts, self.losses = array("q", [0]), array("d")
        self.other_id_starts, self.other_ids = array("q", [0]), array("i")
        self.bytes = 0

    def add(self, words: list[bytes], string: np.ndarray, score: np.ndarray, starts: np.ndarray, ids: np.ndarray) -> None:
        """Append words with their N best, which come by word, best first."""
        first = np.r_[True, string[1:] != string[:-1]]
        heads = np.flatnonzero(first)
        loss = np.repeat(score[heads], np.diff(np.r_[heads, len(string)])) - score
        self.update(zip(words, range(len(self), len(self) + len(words)), strict=True))
        self.scores.frombytes(score[heads].tobytes())
        second = np.minimum(heads + 1, len(string) - 1)
        self.first_loss.frombytes(np.where((heads + 1 < len(string)) & (string[second] == string[heads]), loss[second], np.inf).tobytes())
        for wanted, to_starts, to_ids in ((heads, self.starts, self.ids), (np.flatnonzero(~first), self.other_id_starts, self.other_ids)):
            some, lengths = ragged(starts, ids, wanted)
            to_starts.frombytes((to_starts[-1] + np.cumsum(lengths)).astype(np.int64).tobytes())
            to_ids.frombytes(some.astype(np.int32).tobytes())
        self.losses.frombytes(loss[~first].tobytes())
        self.other_starts.frombytes((self.other_starts[-1] + np.cumsum(np.bincount(string, minlength=len(words)) - 1)).astype(np.int64).tobytes())
        self.bytes += sum(map(len, words)) + 180 * len(words) + 24 * len(string) + 4 * len(ids)

    def learn(self, words: list[bytes]) -> None:
        short, long = [], []
        for w in words:
            (short if len(w) <= self.SHORT else long).append(w)
        if short:
            self.add(short, *self.many([w.decode("utf-8", "surrogatepass") for w in short], self.n))
        for w in long:
            found = self.lattice.nbest(w.decode("utf-8", "surrogatepass"), self.n)
            self.add([w], np.zeros(len(found), np.int64), np.array([s for s, _ in found]), np.r_[0, np.cumsum([len(i) for _, i in found])], np.array([x for _, i in found for x in i], np.int32))

    def numbers(self, words: list[bytes]) -> np.ndarray:
        found = np.fromiter(map(self.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(found < 0).tolist()
        if missing:
            some = [words[i] for i in missing]
            self.learn(list(dict.fromkeys(some)))
            found[missing] = [self[w] for w in some]
        return found

    def others(self, number: int) -> list[tuple[float, int]]:
        """(loss, row of other_ids) of a word."""
        return [(self.losses[j], j) for j in range(self.other_starts[number], self.other_starts[number + 1])]

    def other(self, j: int) -> array:
        return self.other_ids[self.other_id_starts[j] : self.other_id_starts[j + 1]]

    def shrink(self, uses: np.ndarray, most: int) -> None:
        """Keep only words that were used more than once, and of these at most ``most`` of the most used;
        what is used again later is searched again."""
        some = np.flatnonzero(uses > 1)
        some = np.sort(some[np.argsort(-uses[some], kind="stable")[:most]])
        old, words = self.__dict__.copy(), list(self)
        self.reset()
        if not len(some):
            return
        words = [words[i] for i in some.tolist()]
        whole = {k: np.array(v) for k, v in old.items() if isinstance(v, array)}
        ids, lengths = ragged(whole["starts"], whole["ids"], some)
        rows, others = ragged(whole["other_starts"], np.arange(len(whole["losses"])), some)
        other_ids, other_lengths = ragged(whole["other_id_starts"], whole["other_ids"], rows)
        self.update(zip(words, range(len(words)), strict=True))
        for kept, values in (
            (self.scores, whole["scores"][some]), (self.first_loss, whole["first_loss"][some]), (self.starts, np.cumsum(lengths)), (self.ids, ids),
            (self.other_starts, np.cumsum(others)), (self.losses, whole["losses"][rows]), (self.other_id_starts, np.cumsum(other_lengths)), (self.other_ids, other_ids),
        ):
            kept.frombytes(values.tobytes())
        self.bytes = sum(map(len, words)) + 204 * len(words) + 24 * len(rows) + 4 * (len(ids) + len(other_ids))


class Encoder:
    """Texts to their N best segmentations; ``memo_bytes`` bounds the memo between batches."""

    #: A byte that UTF-8 never holds parts words from one another; a text is divided this much at a time.
    PART, STEP = b"\xff", 1 << 20
    #: Words that are looked up together.
    TOGETHER = 100_000

    def __init__(self, v: Vocabulary, n: int, memo_bytes: int = 64 << 20):
        self.v, self.n, self.memo_bytes = v, n, memo_bytes
        self.memo, self.decoder = Memo(Lattice(v), n), Decoder(v)
        self.uses = np.zeros(0, np.int64)

    def divided(self, text: bytes) -> Iterator[list[bytes]]:
        """The words of one text, in lists of bounded size."""
        if not text:
            return
        part, mark = self.PART, MARK.encode()
        s = text.replace(b" ", mark)
        if self.v.dummy_prefix:
            s = mark + s
        if not self.v.splits:
            yield [s]
            return
        s = s.replace(mark, part + mark)
        while (twice := mark + part + mark) in s:  # a run of marks begins one word
            s = s.replace(twice, mark + mark)
        if self.v.newline_alone:
            s = s.replace(b"\n", part + b"\n" + part)
        at = 0
        while at < len(s):
            cut = s.find(part, at + self.STEP) if at + self.STEP < len(s) else -1
            cut = len(s) if cut < 0 else cut
            yield [w for w in s[at:cut].split(part) if w]
            at = cut

    def batch(self, texts: list[bytes]) -> list[list[tuple[float, np.ndarray]]]:
        """Per text its N best (score, ids), best first."""
        memo = self.memo
        if memo.bytes > self.memo_bytes:
            memo.shrink(self.uses, self.memo_bytes // 3 * len(memo) // memo.bytes)
            self.uses = np.zeros(0, np.int64)
        pending, found, counts = [], [], []
        for text in texts:
            counts.append(0)
            for some in self.divided(text):
                counts[-1] += len(some)
                pending += some
                if len(pending) > self.TOGETHER:
                    found.append(memo.numbers(pending))
                    pending = []
        words = np.concatenate([*found, memo.numbers(pending)])
        rows = np.split(words, np.cumsum(counts)[:-1]) if counts else []
        uses = np.bincount(words, minlength=len(memo))
        uses[: len(self.uses)] += self.uses
        self.uses = uses
        ids, lengths = ragged(np.frombuffer(memo.starts, np.int64), np.frombuffer(memo.ids, np.int32) if memo.ids else np.zeros(0, np.int32), words)
        ends = np.r_[0, np.cumsum(lengths)]
        scores = np.frombuffer(memo.scores)[words] if len(words) else np.zeros(0)
        losses = np.frombuffer(memo.first_loss)[words] if len(words) else np.zeros(0)
        out, at = [], 0
        for row in rows:
            stop = at + len(row)
            whole = ids[ends[at] : ends[stop]]
            out.append(self.combine(row, whole, ends[at : stop + 1] - ends[at], float(scores[at:stop].sum()), losses[at:stop]))
            at = stop
        return out

    def combine(self, row: np.ndarray, ids: np.ndarray, ends: np.ndarray, total: float, losses: np.ndarray) -> list[tuple[float, np.ndarray]]:
        """The N best combinations of a chain of words: ``ids`` of the best one, cut at ``ends``."""
        best = [(total, ids)]
        if self.n == 1 or not len(row):
            return best
        # only the occurrences with the smallest first losses can be in the N best combinations
        if self.n == 2:
            some = [int(losses.argmin())]
        else:
            bound = np.partition(losses, self.n - 2)[self.n - 2] if len(losses) >= self.n else math.inf
            near = np.flatnonzero(losses <= bound)
            some = near[np.argsort(losses[near], kind="stable")[: self.n - 1]].tolist()
        combos = [(0.0, ())]
        for i in some:
            alternatives = self.memo.others(int(row[i]))
            if alternatives:
                combos = nsmallest(self.n, [(lost + more, picks + (((i, j),) if j is not None else ())) for lost, picks in combos for more, j in [(0.0, None), *alternatives]])
        for loss, picks in combos[1:]:
            parts, at = [], 0
            for i, j in sorted(picks):
                parts += [ids[at : ends[i]], np.frombuffer(self.memo.other(j), np.int32)]
                at = ends[i + 1]
            best.append((total - loss, np.concatenate([*parts, ids[at:]])))
        return best

    def __call__(self, text: str | None) -> tuple[list[tuple[float, bytes]], bool]:
        """The N best (score, packed ids) of one text, and whether each of them decodes to it."""
        found = self.batch([(text or "").encode("utf-8", "surrogatepass")])[0]
        want = " " * bool(self.v.dummy_prefix and text) + (text or "")
        return [(score, ids.tobytes()) for score, ids in found], all(self.decoder(ids.tolist()) == want for _, ids in found)


class Decoder:
    """Ids to text; byte pieces are joined and decoded as UTF-8."""

    def __init__(self, v: Vocabulary):
        self.table = [p.encode("utf-8") for p in v.pieces]
        for b, i in enumerate(v.byte_ids or ()):
            self.table[i] = bytes([b])

    def __call__(self, ids) -> str:
        table = self.table
        return b"".join([table[i] for i in ids]).decode("utf-8", "surrogatepass").replace(MARK, " ")


def decode(v: Vocabulary, ids) -> str:
    """The text of one sequence of ids, without the dummy prefix."""
    text = Decoder(v)(ids)
    return text[1:] if v.dummy_prefix and text.startswith(" ") else text


def clean_bytes(texts: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null is empty, and bytes that are no UTF-8 are replaced."""
    try:
        texts.validate(full=True)
    except pa.ArrowInvalid:
        return [(x or b"").decode("utf-8", "replace").encode() for x in texts.cast(pa.binary()).to_pylist()]
    return [x or b"" for x in texts.cast(pa.binary()).to_pylist()]


def spans(texts: pa.Array, rows: int, size: int) -> Iterator[tuple[int, int]]:
    """(first row, rows) of parts of a column with at most ``rows`` rows and ``size`` bytes, or one row."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(ends):
        before = int(ends[at - 1]) if at else 0
        stop = min(max(at + 1, int(np.searchsorted(ends, before + size, "right"))), at + rows)
        yield at, stop - at
        at = stop


def encode(docs: DataFrame, v: Vocabulary, n: int = 1, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: the id column, n_tokens, score, ids_xxh64 (of the packed ids), round_trip (whether each of
    the N best, decoded, is the text), the scores and digests of the N best, the best ids and the ids of
    the N best."""
    shipped = docs.sparkSession.sparkContext.broadcast(v)  # bounded by the model file
    key = docs.select(F.col(id_column).alias("doc_id")).schema["doc_id"]
    from pyspark.sql.pandas.types import to_arrow_type

    fields = [("doc_id", to_arrow_type(key.dataType)), ("n_tokens", pa.int64()), ("score", pa.float64()), ("ids_xxh64", pa.int64()), ("round_trip", pa.bool_()), ("nbest_scores", pa.list_(pa.float64())), ("nbest_xxh64", pa.list_(pa.int64()))]
    fields += [("ids", pa.list_(pa.int32())), ("nbest_ids", pa.list_(pa.list_(pa.int32())))]
    schema = pa.schema(fields)

    def run(batches):
        v = shipped.value
        enc = Encoder(v, n)  # lives as long as the task: a reused worker holds no memo afterwards
        bytes_of = pa.array(enc.decoder.table, pa.binary())
        mark, space = MARK.encode(), b" " * v.dummy_prefix
        for batch in batches:
            keys, column = batch.column(0), batch.column(1)
            for at, many in spans(column, 512, 1 << 21):
                texts = clean_bytes(column.slice(at, many))
                found = enc.batch(texts)
                every = [x for f in found for _, x in f]  # all N of each row in turn
                rows = np.r_[0, np.cumsum([len(f) for f in found])].astype(np.int32)
                ends = np.r_[0, np.cumsum([len(x) for x in every])].astype(np.int32)
                flat = np.concatenate(every).astype(np.int32, copy=False)
                decoded = bytes_of.take(pa.array(flat))
                at_byte = np.frombuffer(decoded.buffers()[1], np.int32)[ends].tolist() if len(flat) else [0] * len(ends)
                data = decoded.buffers()[2].to_pybytes() if len(flat) else b""
                whole = []
                for k, t in enumerate(texts):
                    want = space + t if t else t
                    whole.append(all(data[at_byte[j] : at_byte[j + 1]].replace(mark, b" ") == want for j in range(rows[k], rows[k + 1])))
                digests = np.array([xxhash.xxh3_64_intdigest(np.ascontiguousarray(x)) for x in every], np.uint64).astype(np.int64)
                firsts = rows[:-1]
                arrays = [
                    keys.slice(at, many).cast(fields[0][1]), pa.array(np.diff(ends)[firsts], pa.int64()), pa.array([f[0][0] for f in found], pa.float64()),
                    pa.array(digests[firsts]), pa.array(whole, pa.bool_()), pa.ListArray.from_arrays(pa.array(rows), pa.array([s for f in found for s, _ in f], pa.float64())),
                    pa.ListArray.from_arrays(pa.array(rows), pa.array(digests)),
                ]
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
                arrays += [lists.take(pa.array(firsts)), pa.ListArray.from_arrays(pa.array(rows), lists)]
                yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    from pyspark.sql.pandas.types import from_arrow_schema

    return docs.select(F.col(id_column), F.col(text_column).cast("string")).mapInArrow(run, from_arrow_schema(schema))


def decode_column(spark: SparkSession, v: Vocabulary):
    """A column function ids -> text."""
    shipped = spark.sparkContext.broadcast(v)

    @F.pandas_udf("string")
    def run(ids):
        decoder, v = Decoder(shipped.value), shipped.value
        return ids.map(lambda x: None if x is None else decoder(x)[int(v.dummy_prefix and len(x) > 0) :])

    return run
