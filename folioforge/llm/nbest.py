"""N-best segmentation with the pieces of a SentencePiece model.

A forward Viterbi pass over the piece lattice gives the best score of every
prefix. Those scores are exact heuristics for an A-star search that grows
segmentations backward from the end, so that they come out best first.

No piece has a word mark after another character or a line feed beside other
characters, so that the lattice of a text falls apart there into words; pieces of
several marks exist, and a run of marks is one word with what follows. (A model
with other pieces gets whole lines.) The forward and backward passes go over all
new words of a batch at once.

Where the lattice falls apart, so does the search. A segmentation of the text is
one of each word, and its cost above the best is the sum of what its words cost
above theirs. Order the words by what their second best costs more, ties by
place. If a segmentation changes a word that is not among the first n - 1, then
changing just one of those n - 1 instead costs no more, and so does changing
nothing: n segmentations at no higher cost. So there are n best that change only
the first n - 1 words, and A-star runs over the text's lattice with every other
word's best path contracted to its score.
"""

from __future__ import annotations

import heapq
import math
import re
import zlib
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Numbers, map_rows

MARK = "▁"
WORD = re.compile("▁+[^▁\n]*|[^▁\n]+|\n")
#: Finer words, for models without a piece from a Latin letter to another character or back.
LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"
FINE_WORD = re.compile(f"▁*[{LATIN}]+|▁*[^▁\n{LATIN}]+|\n|▁+")
ALL, LINE, INSIDE = re.compile("(?s).+"), re.compile("[^\n]+|\n"), re.compile("[^▁]▁")
CROSSING = re.compile(f"[{LATIN}][^{LATIN}]|[^▁{LATIN}][{LATIN}]")
LONG = 64


class Pieces:
    """Pieces and scores of a model, with segmentation and decoding.

    ``scores`` is "model" for the model's own, "rank" for Zipf's law over the
    order of them: a piece of rank r has -log(r + 1) less the log of the sum over
    all. The default is the model's own for a unigram model and "rank" for a BPE
    model, which has only the order of its merges, as whole numbers: added up,
    they favour many frequent pieces. (Measured on the given BPE model: 80 % of
    the words of check_s get the library's own segmentation by rank, 55 % by the
    merge numbers.) A character without a piece becomes byte pieces, each a
    little worse than the worst piece.
    """

    def __init__(self, path: str, scores: str | None = None, most_words: int = 400_000) -> None:
        if scores not in (None, "model", "rank"):
            raise ValueError("scores is model or rank")
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        raw = {}
        self.text, self.byte = [], {}
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            self.text.append(piece)
            if model.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                raw[piece] = (i, model.get_score(i))
        ranked = sorted(raw, key=lambda p: -raw[p][1])
        if scores == "rank" or scores is None and all(s == int(s) for _, s in raw.values()):
            total = math.log(sum(1 / (r + 1) for r in range(1, len(ranked) + 1)))
            raw = {p: (raw[p][0], -math.log(r + 1) - total) for r, p in enumerate(ranked, 1)}
        self.pieces, self.spells, self.byte_of = raw, {i for i, _ in raw.values()}, {i: b for b, i in self.byte.items()}
        self.sound = [chr(self.byte_of[i]) if i in self.byte_of else t for i, t in enumerate(self.text)]  # as single bytes spell
        self.width = np.array([len(x) for x in self.sound], dtype=np.int64)
        breaks, inside, crossing = any("\n" in p and p != "\n" for p in raw), any(map(INSIDE.search, raw)), any(map(CROSSING.search, raw))
        self.word = ALL if breaks else LINE if inside else WORD if crossing else FINE_WORD
        self.longest = max(map(len, raw))
        self.worst = min(s for _, s in raw.values()) - 1.0
        self.most_words, self.lattices, self.lists = most_words, {}, {}
        self.forget()
        self._trie()

    def forget(self) -> None:
        """Known words: their numbers, best scores, what their second best costs
        more, and where in ``ids`` their best's ids are."""
        self.number = Numbers()
        self.best, self.more = np.zeros(0), np.zeros(0)
        self.first, self.size = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        self.ids, self.good = np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=bool)

    def _trie(self) -> None:
        """Sorted (node, character) keys and their child nodes; piece of a node."""
        nodes: dict[str, int] = {"": 0}
        single = {chr(b): (i, self.worst) for b, i in self.byte.items() if b < 128 and chr(b) not in self.pieces}
        known = self.pieces | single
        for piece in sorted(known):
            for i in range(1, len(piece) + 1):
                nodes.setdefault(piece[:i], len(nodes))
        keys = np.array([nodes[x[:-1]] << 21 | ord(x[-1]) for x in nodes if x], dtype=np.int64)
        child = np.array([n for x, n in nodes.items() if x], dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.child = keys[order], child[order]
        self.node_id = np.full(len(nodes), -1, dtype=np.int64)
        self.node_score = np.full(len(nodes), -np.inf)
        for piece, (i, score) in known.items():
            self.node_id[nodes[piece]], self.node_score[nodes[piece]] = i, score

    def best_two_of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """best_two of many words at once: their best scores, what the second best
        costs more, how many ids the best has, and the ids one after the other."""
        data = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        size = np.array([len(w) for w in words], dtype=np.int64)
        ends = np.cumsum(size)
        word = np.repeat(np.arange(len(words)), size)
        stop, begin = ends[word], (ends - size)[word]
        start = at = np.arange(len(data))
        node = np.zeros(len(data), dtype=np.int64)
        parts = []
        while len(start):
            want = node << 21 | data[at]
            i = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
            ok = self.keys[i] == want
            start, at, node = start[ok], at[ok] + 1, self.child[i[ok]]
            has = self.node_id[node] >= 0
            parts.append((start[has], at[has], node[has]))
            go = at < stop[start]
            start, at, node = start[go], at[go], node[go]
        start, at, node = (np.concatenate([p[i] for p in parts]) for i in range(3))
        score, piece, of = self.node_score[node], self.node_id[node], word[start]
        rel_s, rel_e = start - begin[start], at - begin[start]
        # nodes of the lattice: one more than characters in each word
        s, e = start + of, at + of
        first_node, last_node = ends - size + np.arange(len(words)), ends + np.arange(len(words))
        total = len(data) + len(words)
        best, back = np.full(total, -np.inf), np.full(total, -1, dtype=np.int64)
        best[first_node] = 0.0
        order = np.argsort((rel_e << 40) | e)
        cuts = np.searchsorted(rel_e[order], np.arange(1, (rel_e.max() if len(rel_e) else 0) + 2))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            g = order[a:b]
            if not len(g):
                continue
            cand = best[s[g]] + score[g]
            run = np.flatnonzero(np.r_[True, e[g][1:] != e[g][:-1]])
            top = np.maximum.reduceat(cand, run)
            which = np.repeat(np.arange(len(run)), np.diff(np.r_[run, len(g)]))
            hit = np.flatnonzero(cand == top[which])
            hit = hit[np.r_[True, which[hit][1:] != which[hit][:-1]]]
            best[e[g][run]], back[e[g][run]] = top, g[hit]
        rear = np.full(total, -np.inf)
        rear[last_node] = 0.0
        order = np.argsort((-rel_s << 40) + s)
        cuts = np.searchsorted(-rel_s[order], np.arange(-(rel_s.max() if len(rel_s) else 0), 2))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            g = order[a:b]
            if len(g):
                run = np.flatnonzero(np.r_[True, s[g][1:] != s[g][:-1]])
                rear[s[g][run]] = np.maximum.reduceat(score[g] + rear[e[g]], run)
        used = np.zeros(len(s), dtype=bool)
        cur, live = last_node.copy(), np.flatnonzero((size > 0) & (best[last_node] > -np.inf))
        while len(live):
            edge = back[cur[live]]
            used[edge] = True
            cur[live] = s[edge]
            live = live[cur[live] != first_node[live]]
        second = np.full(len(words), -np.inf)
        other = ~used
        np.maximum.at(second, of[other], (best[s] + score + rear[e])[other])
        on = np.flatnonzero(used)
        on = on[np.argsort(s[on], kind="stable")]
        top = best[last_node]
        with np.errstate(invalid="ignore"):
            return top, top - second, np.bincount(of[on], minlength=len(words)), piece[on]

    def normalize(self, text: str) -> str:
        return (MARK + text.replace(" ", MARK)) if text else ""

    def spelled(self, ids: list[int] | tuple[int, ...]) -> str:
        """The characters of ids, word marks as they are."""
        out, held = [], bytearray()
        for i in ids:
            if (b := self.byte_of.get(i)) is not None:
                held.append(b)
                continue
            if held:
                out.append(held.decode("utf-8", "replace"))
                held.clear()
            if i in self.spells:
                out.append(self.text[i])
        if held:
            out.append(held.decode("utf-8", "replace"))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        return self.spelled(ids).replace(MARK, " ")[1:]

    def edges(self, word: str) -> list[list[tuple[int, float, tuple[int, ...]]]]:
        """For each end position the (start, score, ids) of edges that end there."""
        n = len(word)
        out: list[list] = [[] for _ in range(n + 1)]
        get = self.pieces.get
        for i in range(n):
            for j in range(i + 1, min(n, i + self.longest) + 1):
                if (p := get(word[i:j])) is not None:
                    out[j].append((i, p[1], (p[0],)))
            if word[i] not in self.pieces:
                ids = tuple(self.byte[b] for b in word[i].encode("utf-8", "surrogatepass"))
                out[i + 1].append((i, self.worst * len(ids), ids))
        return out

    def forward(self, edges: list[list]) -> tuple[list[float], list]:
        best, back = [0.0] + [-math.inf] * (len(edges) - 1), [None] * len(edges)
        for j in range(1, len(edges)):
            for e in edges[j]:
                if (s := best[e[0]] + e[1]) > best[j]:
                    best[j], back[j] = s, e
        return best, back

    def best_two(self, word: str) -> tuple[float, tuple[int, ...], float]:
        """The best score and ids of a word, and what the second best costs more."""
        edges = self.edges(word)
        best, back = self.forward(edges)
        n = len(edges) - 1
        rear = [-math.inf] * n + [0.0]
        path, j = [], n
        while j:
            path.append(back[j])
            j = back[j][0]
        used = set(map(id, path))
        second = -math.inf
        for j in range(n, 0, -1):
            if rear[j] == -math.inf:
                continue
            for e in edges[j]:
                s = e[1] + rear[j]
                if s > rear[e[0]]:
                    rear[e[0]] = s
                if id(e) not in used and best[e[0]] + s > second:
                    second = best[e[0]] + s
        return best[n], tuple(i for e in reversed(path) for i in e[2]), best[n] - second

    def lattice(self, word: str) -> list:
        if (found := self.lattices.get(word)) is None:
            if len(self.lattices) >= self.most_words // 10:
                self.lattices = {}
            found = self.lattices[word] = self.edges(word)
        return found

    def nbest(self, words: tuple[str, ...], n: int, most: float = math.inf) -> list[tuple[float, tuple[tuple[int, ...], ...]]]:
        """The n best segmentations of words that no piece joins, best first, as
        scores and each word's ids; equal scores in the order of ids. The caller
        may know that n of them cost at most ``most`` above the best."""
        if (found := self.lists.get((words, n))) is not None:
            return found
        edges, ends = [[]], []
        for word in words:
            at = len(edges) - 1
            edges += [[(start + at, score, ids) for start, score, ids in here] for here in self.lattice(word)[1:]]
            ends.append(len(edges) - 1)
        best, _ = self.forward(edges)
        # Among equal costs the node nearest the end comes first: when a node is
        # taken, all its equal ends are known, and the n first of them suffice.
        agenda: list[tuple] = [(round(-best[-1], 9), 1 - len(edges), (), 0.0, ())]
        out: list[tuple[float, tuple[tuple[int, ...], ...]]] = []
        taken, most = [0] * len(edges), most + 1e-6 - best[-1]
        while agenda and len(out) < n:
            _, at, ids, behind, path = heapq.heappop(agenda)
            if taken[-at] == n:
                continue
            taken[-at] += 1
            if not at:
                cuts, marks = [0, *ends], list(path)
                out.append((behind, tuple(tuple(chain.from_iterable(own for start, own in marks if a <= start < b)) for a, b in zip(cuts, cuts[1:], strict=False))))
                continue
            for start, score, own in edges[-at]:
                cost = -(best[start] + score + behind)  # of the best segmentation that ends so
                if cost <= most and cost < math.inf and taken[start] < n:
                    heapq.heappush(agenda, (round(cost, 9), -start, own + ids, behind + score, ((start, own), *path)))
        if len(self.lists) >= self.most_words // 10:
            self.lists = {}
        self.lists[words, n] = out
        return out

    def learn(self, words: list[str]) -> np.ndarray:
        """Numbers of the words, in order. New words get theirs; beyond a bound all
        known ones are forgotten first, which costs time only."""
        if len(self.number) > self.most_words:
            self.forget()
        known = len(self.number)
        numbers, new = self.number.of(words)
        if not new:
            return numbers
        for name in ("best", "more", "first", "size", "good"):
            x = getattr(self, name)
            setattr(self, name, np.concatenate([x, np.zeros(len(new), dtype=x.dtype)]))
        lost = [i for i, w in enumerate(new) if len(w) > LONG]
        short = [i for i, w in enumerate(new) if len(w) <= LONG] if lost else list(range(len(new)))
        for i in range(0, len(short), 20_000):
            at = np.array(short[i : i + 20_000])
            part = [new[j] for j in at]
            best, more, size, ids = self.best_two_of(part)
            if (bad := best == -np.inf).any():  # characters that only bytes can spell
                lost += at[bad].tolist()
                at, best, more, size = at[~bad], best[~bad], more[~bad], size[~bad]
                part = [new[j] for j in at]
            good = np.array_equal(np.add.reduceat(self.width[ids], np.cumsum(size) - size), [len(w) for w in part]) if part else True
            good = good and "".join(map(self.sound.__getitem__, ids.tolist())) == "".join(part)
            self._put(at + known, best, more, size, ids, good)
        if lost:
            facts = [self.best_two(new[j]) for j in lost]
            good = np.array([self.spelled(f[1]) == new[j] for j, f in zip(lost, facts, strict=True)])
            best, more, size = (np.array(x) for x in zip(*((f[0], f[2], len(f[1])) for f in facts), strict=True))
            self._put(np.array(lost) + known, best, more, size, np.fromiter(chain.from_iterable(f[1] for f in facts), dtype=np.int64), good)
        return numbers

    def _put(self, at: np.ndarray, best: np.ndarray, more: np.ndarray, size: np.ndarray, ids: np.ndarray, good: np.ndarray | bool) -> None:
        self.best[at], self.more[at], self.size[at], self.good[at] = best, more, size, good
        self.first[at] = np.cumsum(size) - size + len(self.ids)
        self.ids = np.concatenate([self.ids, ids.astype(np.uint32)])

    def ids_of(self, numbers: np.ndarray) -> np.ndarray:
        """The best's ids of all these words, one after the other."""
        size = self.size[numbers]
        return self.ids[np.repeat(self.first[numbers] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))]

    def split(self, text: str | None) -> list[str]:
        """The words of a text, as far as pieces can reach: from a word mark to the
        next or a line's end, and within that letters and other characters."""
        return self.word.findall(self.normalize(text)) if text else []

    def text_nbest(self, words: list[str], numbers: np.ndarray, n: int) -> tuple[list[float], list[dict[int, tuple[int, ...]]]]:
        """Scores of the n best segmentations of a text given as its learned words,
        and for each the ids of the words in which it differs from the best."""
        total = float(self.best[numbers].sum())
        at = _smallest(self.more[numbers], n - 1)
        if not at:
            return [total], [{}]
        most = float(self.more[numbers[at]].max()) if len(at) == n - 1 else math.inf  # one change in each of them
        found = self.nbest(tuple(words[i] for i in at), n, most)
        scores, ways = [total + score - found[0][0] for score, _ in found], [ids for _, ids in found]
        # The best is the one of the learned ids; of several that cost as little, the search may name another first.
        best = tuple(tuple(self.ids_of(numbers[i : i + 1]).tolist()) for i in at)
        if ways[0] != best:
            ways = [best, *[w for w in ways if w != best]][: len(ways)]
        return scores, [{i: own for i, own, first in zip(at, ids, best, strict=True) if own != first} for ids in ways]


def _smallest(cost: np.ndarray, n: int) -> list[int]:
    """Places of the n smallest finite costs, in order; of equal ones the first."""
    if n < 1 or not len(cost):
        return []
    limit = np.partition(cost, min(n, len(cost)) - 1)[min(n, len(cost)) - 1]
    at = np.flatnonzero((cost <= limit) & (cost < np.inf))
    return sorted(at[np.argsort(cost[at], kind="stable")][:n].tolist())


@lru_cache(maxsize=2)
def loaded(path: str, scores: str | None = None) -> Pieces:
    return Pieces(path, scores)


def segment(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", n: int = 4, scores: str | None = None, with_ids: bool = True) -> DataFrame:
    """One row per row of docs: (id_col, n_pieces, ids_crc32, best_score, n_found,
    scores, changed, round_trip), and ids and changed_ids ``with_ids``.

    ids are those of the best segmentation of the whole text, n_pieces their
    number and ids_crc32 their checksum (unsigned, of little-endian unsigned
    32-bit ids). scores are those of the up to n best, best first; changed has,
    for each of them, the words in which it differs from the best; round_trip
    says that the best decodes to the text. changed_ids has, for each word that
    changed names, its ids, which replace ``length`` of the best's ids from
    ``start`` on (from 0): so all n segmentations are there whole. What ``scores``
    are: see Pieces. Of segmentations that cost the same, those that change earlier
    words are found.
    A null or empty text has no pieces, score 0 and one (empty) segmentation.
    One pass, no shuffle; rows repeat as in docs, ids may be null; other columns
    are not read.
    """

    def run(cols: list[list]) -> list:
        p = loaded(model, scores)
        split = [p.split(t) for t in cols[1]]
        numbers = p.learn(list(chain.from_iterable(split)))
        ends = np.cumsum([0, *map(len, split)])
        out: list[list] = [[] for _ in range(6)]
        other: list[list] = []
        flat, cuts = p.ids_of(numbers), np.concatenate([[0], np.cumsum(p.size[numbers])])[ends]
        for words, text, a, b, lo, hi in zip(split, cols[1], ends[:-1].tolist(), ends[1:].tolist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            of, changes = p.text_nbest(words, numbers[a:b], n)
            whole = not text or bool(p.good[numbers[a:b]].all()) and sum(map(len, words)) == len(text) + 1
            for c, v in zip(out, (hi - lo, zlib.crc32(flat[lo:hi].astype("<u4").tobytes()), of, len(of), [sorted(x) for x in changes], whole), strict=True):
                c.append(v)
            size = p.size[numbers[a:b]]
            start = np.cumsum(size) - size
            other.append([[{"start": int(start[i]), "length": int(size[i]), "ids": list(x[i])} for i in sorted(x)] for x in changes])
        ids = [pa.ListArray.from_arrays(pa.array(cuts, type=pa.int32()), pa.array(flat.astype(np.int32))), other] if with_ids else []
        return [cols[0], out[0], out[1], [s[0] for s in out[2]], out[3], out[2], out[4], out[5], *ids]

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = "id long, n_pieces long, ids_crc32 long, best_score double, n_found int, scores array<double>, changed array<array<int>>, round_trip boolean" + ", ids array<int>, changed_ids array<array<struct<start:int,length:int,ids:array<int>>>>" * with_ids
    return map_rows(rows, schema, run).withColumnRenamed("id", id_col)


def decode(rows: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per row of rows: (id_col, text), the text that the ids spell.

    Null ids give null, none give an empty text; control and unknown ids and
    those beyond the model spell nothing. Bytes that are no UTF-8 become U+FFFD.
    One pass, no shuffle; rows repeat, other columns are not read.
    """

    def run(cols: list[list]) -> list:
        p = loaded(model)
        return [cols[0], [None if ids is None else p.decode(ids) for ids in cols[1]]]

    out = rows.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return map_rows(out, "id long, text string", run).withColumnRenamed("id", id_col)
