"""Unigram pieces: SentencePiece encoding and decoding, and token counts over a shared trie.

Encoding is Viterbi over a double-array trie of pieces with log scores. Spaces become the marker U+2581, one more goes in
front; a character that no piece covers falls back to the pieces of its UTF-8 bytes. Decoding joins pieces, turns markers
into spaces and drops the first. Of equally good segmentations the one whose last piece starts earliest wins, from the end on.

Where no piece holds a marker after another character, or a line end, a text falls apart at spaces and line ends
without changing the result, so each distinct part is segmented once per batch; what a worker remembers is bounded.

Token counts insert a batch's distinct pre-tokens in a trie and go down it level by level: the best score and its number of
pieces belong to a node, so pre-tokens with a common prefix share its work; nodes that end a pre-token hold its count.

The vocabulary is a file whose path is a parameter: it is read on the driver and sent with the task; its size is that of
the vocabulary. Its published merge ranks r become log scores by Zipf's law, -ln((r + 1) * H), rounded to 1/1024 so that sums
are exact.

Defined cases: NULL text is encoded as NULL and has 0 tokens; empty text has no pieces; a marker character in the text
decodes to a space, the one case in which a round trip differs; repeated rows are encoded each; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

MARKER = "▁"
UNKNOWN_PENALTY = 10.0
REMEMBERED = 200_000
SLICE_CHARS = 2_000_000


@dataclass
class Vocabulary:
    """Pieces by id, their scores, the ids of byte pieces, and which pieces may be matched."""

    pieces: list[str]
    scores: np.ndarray
    byte_ids: np.ndarray
    normal: np.ndarray
    trie: tuple = field(default=())


def load_vocabulary(path: str) -> Vocabulary:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    pieces = [model.id_to_piece(i) for i in range(n)]
    byte_ids = np.full(256, -1, np.int32)
    for i in range(n):
        if model.is_byte(i):
            byte_ids[int(pieces[i][3:5], 16)] = i
    normal = np.array([not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) for i in range(n)])
    ranks = np.maximum(0, -np.array([model.get_score(i) for i in range(n)]))
    total = np.log((1 / (1 + np.arange(max(1, normal.sum())))).sum())
    scores = np.round(-1024 * (np.log1p(ranks) + total)) / 1024
    return Vocabulary(pieces, scores, byte_ids, normal)


def double_array(words: list[tuple[int, ...]], values: list[int], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """base, check, value of a double-array trie: from state s the symbol c (1 .. width) leads to base[s] + c if check there is s."""
    children: list[dict[int, int]] = [{}]
    ends = {}
    for word, value in zip(words, values, strict=True):
        at = 0
        for c in word:
            at = children[at].setdefault(c, len(children))
            if at == len(children):
                children.append({})
        ends[at] = value
    used = bytearray(2 * len(children) + 2 * width + 64)
    used[0] = 1
    places: list[tuple[int, int, int]] = []  # state, base, node
    parents = {}
    first_free, queue = 1, [(0, 0)]
    for node, state in queue:
        symbols = sorted(children[node])
        if not symbols:
            places.append((state, 0, node))
            continue
        first_free = at = used.find(0, first_free)
        while True:
            at = used.find(0, at)
            if at < 0 or at + width >= len(used):
                at = at if at >= 0 else len(used)
                used.extend(bytes(len(used)))
                continue
            start = at - symbols[0]
            if start >= 1 and not any(used[start + c] for c in symbols):
                break
            at += 1
        for c in symbols:
            used[start + c] = 1
            parents[start + c] = state
            queue.append((children[node][c], start + c))
        places.append((state, start, node))
    room = max(max(s, b + width) for s, b, _ in places) + 1
    base, check, value = np.zeros(room, np.int32), np.full(room, -1, np.int32), np.full(room, -1, np.int32)
    for state, start, node in places:
        base[state], check[state], value[state] = start, parents.get(state, 0), ends.get(node, -1)
    return base, check, value


class Segmenter:
    """Segments parts of texts; made on the driver, sent to tasks."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        own = [i for i in np.flatnonzero(vocabulary.normal).tolist() if vocabulary.pieces[i]]
        texts = [vocabulary.pieces[i] for i in own]
        self.alphabet = sorted({ord(c) for t in texts for c in t})
        number = {c: k + 1 for k, c in enumerate(self.alphabet)}
        self.base, self.check, self.value = double_array([tuple(number[ord(c)] for c in t) for t in texts], own, len(self.alphabet))
        self.scores, self.byte_ids = vocabulary.scores, vocabulary.byte_ids
        self.unknown = float(min(vocabulary.scores[own])) - UNKNOWN_PENALTY
        crossing = any(re.search(f"[^{MARKER}]{MARKER}", t) for t in texts)
        lines = "" if any("\n" in t for t in texts) else "\n"
        self.parts = re.compile(f" +[^ {lines}]*|[^ {lines}]+|\n" if not crossing else r"(?s).+")
        self.bytes_of = [
            b"" if not ok else p.replace(MARKER, " ").encode() for p, ok in zip(vocabulary.pieces, vocabulary.normal, strict=True)]
        for b, i in enumerate(self.byte_ids.tolist()):
            if i >= 0:
                self.bytes_of[i] = bytes([b])
        self._codes: np.ndarray | None = None

    def split(self, text: str) -> list[str]:
        """Parts that can be segmented apart; a space stands for the marker."""
        return self.parts.findall(" " + text) if text else []

    def codes(self, points: np.ndarray) -> np.ndarray:
        if self._codes is None:
            self._codes = np.zeros(0x110000, np.int32)
            self._codes[self.alphabet] = np.arange(1, len(self.alphabet) + 1)
        return self._codes[points]

    def _fallback(self, char: str) -> list[int]:
        return self.byte_ids[list(char.encode("utf-8", "surrogatepass"))].tolist()

    def viterbi(self, parts: list[str]) -> list[list[int]]:
        """Ids of each part."""
        out: list[list[int]] = [[]] * len(parts)
        order = sorted(range(len(parts)), key=lambda k: len(parts[k]))
        at = 0
        while at < len(order):
            longest = len(parts[order[min(len(order), at + 8192) - 1]])
            some = order[at:at + max(1, min(8192, 400_000 // max(1, longest)))]
            at += len(some)
            for k, ids in zip(some, self._viterbi([parts[k].replace(" ", MARKER) for k in some]), strict=True):
                out[k] = ids
        return out

    def _viterbi(self, parts: list[str]) -> Iterator[list[int]]:
        if len(parts) == 1 and len(parts[0]) > 256:
            yield self._one(parts[0])
            return
        n, longest = len(parts), max(map(len, parts))
        points = np.frombuffer("".join(p.ljust(longest, "\0") for p in parts).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(n, longest)
        length = np.array([len(p) for p in parts])
        codes = self.codes(points)
        best = np.full((n, longest + 1), -np.inf)
        best[:, 0] = 0
        start, piece = np.zeros((n, longest + 1), np.int32), np.full((n, longest + 1), -1, np.int32)
        for i in range(longest):
            rows = np.flatnonzero(length > i)
            single = np.zeros(n, bool)
            state, every = np.zeros(len(rows), np.int64), rows
            for j in range(i, longest):
                c = codes[rows, j]
                to = self.base[state] + c
                ok = (c > 0) & (self.check[to] == state) & (length[rows] > j)
                rows, state = rows[ok], to[ok]
                if not len(rows):
                    break
                found = self.value[state]
                whole = np.flatnonzero(found >= 0)
                r, ids = rows[whole], found[whole]
                if j == i:
                    single[r] = True
                total = best[r, i] + self.scores[ids]
                better = total > best[r, j + 1]
                r, ids = r[better], ids[better]
                best[r, j + 1], start[r, j + 1], piece[r, j + 1] = total[better], i, ids
            r = every[~single[every]]
            total = best[r, i] + self.unknown
            better = total > best[r, i + 1]
            r = r[better]
            best[r, i + 1], start[r, i + 1], piece[r, i + 1] = total[better], i, -1
        starts, ids = start.tolist(), piece.tolist()
        for k, part in enumerate(parts):
            yield self._back(part, starts[k], ids[k])

    def _back(self, part: str, starts: list[int], ids: list[int]) -> list[int]:
        found, at = [], len(part)
        while at:
            i = ids[at]
            if i >= 0:
                found.append(i)
            else:
                found.extend(reversed(self._fallback(part[at - 1])))
            at = starts[at]
        found.reverse()
        return found

    def _one(self, part: str) -> list[int]:
        """The same for one long part, a position at a time."""
        codes = self.codes(np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)).tolist()
        base, check, value, scores = self.base, self.check, self.value, self.scores
        n = len(codes)
        best, start, piece = [float("-inf")] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        for i in range(n):
            state, single, here = 0, False, best[i]
            for j in range(i, n):
                to = int(base[state]) + codes[j]
                if not codes[j] or check[to] != state:
                    break
                state = to
                found = int(value[state])
                if found >= 0:
                    single |= j == i
                    total = here + float(scores[found])
                    if total > best[j + 1]:
                        best[j + 1], start[j + 1], piece[j + 1] = total, i, found
            if not single and here + self.unknown > best[i + 1]:
                best[i + 1], start[i + 1], piece[i + 1] = here + self.unknown, i, -1
        return self._back(part, start, piece)

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")[1:]

    def trie_counts(self, parts: list[str]) -> list[int]:
        """Pieces of each distinct part, from a trie of the parts: work per node, not per part."""
        if not parts:
            return []
        order = sorted(range(len(parts)), key=parts.__getitem__)
        texts = [parts[k].replace(" ", MARKER) for k in order]
        length = np.array([len(t) for t in texts])
        flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        first = np.cumsum(length) - length
        n = len(texts)
        shared = np.zeros(n, np.int64)  # characters in common with the text before
        going = np.arange(1, n)
        d = 0
        while len(going):
            going = going[(length[going] > d) & (length[going - 1] > d)]
            going = going[flat[first[going] + d] == flat[first[going - 1] + d]]
            shared[going] = d + 1
            d += 1
        result = np.zeros(n, np.int64)
        # nodes of one depth: score, pieces; threads: node, score and pieces at their start, state in the pieces' trie
        score, count = np.zeros(1), np.zeros(1, np.int64)
        node_of = np.zeros(n, np.int64)
        rows = np.arange(n)
        t_node, t_score, t_count, t_state = (np.zeros(0, x) for x in (np.int64, float, np.int64, np.int64))
        for depth in range(int(length.max(initial=0))):
            last = rows
            rows = rows[length[rows] > depth]
            if depth == 0:
                gap = shared[rows]
            else:  # least in common with any text since the last row that goes on
                spot = np.searchsorted(last, rows)
                low = np.minimum.accumulate(shared[last]) if len(rows) == 0 else np.minimum.reduceat(shared[last], np.append(0, spot[:-1] + 1))
                shared = shared.copy()
                shared[rows] = low[:len(rows)]
                gap = shared[rows]
            fresh = gap <= depth
            fresh[0] = True
            child = np.cumsum(fresh) - 1
            head = rows[fresh]
            parent = node_of[head]
            chars = flat[first[head] + depth]
            code = self.codes(chars)
            # threads of each parent go to each child, and one starts there
            per = np.bincount(t_node, minlength=len(score))
            begin = np.cumsum(per) - per
            take = per[parent]
            source = np.repeat(begin[parent] - (np.cumsum(take) - take), take) + np.arange(take.sum())
            kid = np.append(np.repeat(np.arange(len(head)), take), np.arange(len(head)))
            state = np.append(t_state[source], np.zeros(len(head), np.int64))
            from_score, from_count = np.append(t_score[source], score[parent]), np.append(t_count[source], count[parent])
            new = np.arange(len(kid)) >= take.sum()
            to = self.base[state] + code[kid]
            ok = (code[kid] > 0) & (self.check[to] == state)
            kid, state, from_score, from_count, new = kid[ok], to[ok].astype(np.int64), from_score[ok], from_count[ok], new[ok]
            found = self.value[state]
            whole = found >= 0
            single = np.zeros(len(head), bool)
            single[kid[whole & new]] = True
            lone = np.flatnonzero(~single)
            size = 1 + (chars[lone] > 0x7F) + (chars[lone] > 0x7FF) + (chars[lone] > 0xFFFF)
            c_kid = np.concatenate([kid[whole], lone])
            c_score = np.concatenate([from_score[whole] + self.scores[found[whole]], score[parent[lone]] + self.unknown])
            c_count = np.concatenate([from_count[whole] + 1, count[parent[lone]] + size])
            # threads of a node are in the order of their starts, so a stable sort keeps the earliest of equals first
            rank = np.lexsort((np.arange(len(c_kid)), -c_score, c_kid))
            top = rank[np.append(True, c_kid[rank][1:] != c_kid[rank][:-1])]
            score, count = c_score[top], c_count[top]
            by = np.argsort(kid, kind="stable")
            t_node, t_score, t_count, t_state = kid[by], from_score[by], from_count[by], state[by]
            node_of[rows] = child
            ends = rows[length[rows] == depth + 1]
            result[ends] = count[node_of[ends]]
        out = np.zeros(n, np.int64)
        out[order] = result
        return out.tolist()


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about SLICE_CHARS of text (column 1)."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        end = int(np.searchsorted(size, (size[at - 1] if at else 0) + SLICE_CHARS, "right"))
        end = max(at + 1, end)
        yield batch.slice(at, end - at)
        at = end


def encoded(docs: DataFrame, segmenter: Segmenter, check: bool = True) -> DataFrame:
    """doc_id, ids (array<int>), n_pieces, and with ``check`` whether decoding gives the text back."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, bytes] = {}
        for batch in batches:
            for part in _slices(batch):
                texts = part.column(1).to_pylist()
                split = [segmenter.split(t) if t is not None else [] for t in texts]
                missing = list(set().union(*split) - known.keys())
                if len(known) + len(missing) > REMEMBERED:
                    known, missing = {}, list(set().union(*split))
                for p, ids in zip(missing, segmenter.viterbi(missing), strict=True):
                    known[p] = np.array(ids, np.int32).tobytes()
                joined = [b"".join(map(known.__getitem__, s)) for s in split]
                flat = np.frombuffer(b"".join(joined), np.int32)
                ends = np.cumsum([0] + [len(j) // 4 for j in joined])
                blank = pa.array([t is None for t in texts])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
                columns = [part.column(0), pc.if_else(blank, pa.scalar(None, lists.type), lists), pa.array(np.diff(ends))]
                names = ["doc_id", "ids", "n_pieces"]
                if check:
                    every = flat.tolist()
                    back = [segmenter.decode(every[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                    columns.append(pa.array([t is None or t == b for t, b in zip(texts, back, strict=True)]))
                    names.append("round_trip")
                yield pa.RecordBatch.from_arrays(columns, names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids array<int>, n_pieces long" + ", round_trip boolean" * check)


def decoded(ids: DataFrame, segmenter: Segmenter) -> DataFrame:
    """doc_id and text for rows (doc_id, ids); NULL ids give NULL text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if x is None else segmenter.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return ids.select("doc_id", "ids").mapInArrow(run, f"doc_id {ids.schema['doc_id'].dataType.simpleString()}, text string")


def token_counts(docs: DataFrame, segmenter: Segmenter) -> DataFrame:
    """doc_id, n_pretokens (parts of the text), n_tokens (pieces of its best segmentation)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            for part in _slices(batch):
                split = [segmenter.split(t) if t is not None else [] for t in part.column(1).to_pylist()]
                missing = list(set().union(*split) - known.keys())
                if len(known) + len(missing) > REMEMBERED:
                    known, missing = {}, list(set().union(*split))
                known.update(zip(missing, segmenter.trie_counts(missing), strict=True))
                tokens = [sum(map(known.__getitem__, s)) for s in split]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(s) for s in split], pa.int64()), pa.array(tokens, pa.int64())], ["doc_id", "n_pretokens", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_pretokens long, n_tokens long")
