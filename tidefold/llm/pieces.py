"""SentencePiece encoding and decoding as shortest paths of a weighted transducer.

A model file is compiled to three machines. The normaliser rewrites a text from left
to right, each time by the longest rule that fits, then folds and marks spaces. The
lexicon is a trie whose final nodes are pieces at the weight of their negative score;
a character that is no piece has an arc of its own, to its bytes or to the unknown id.
The acceptor reads pieces: of unigram models it lets every pair pass, of models made
by merging only pairs that merging what they spell gives again.

Composed with an input, these have one state for each position and last piece. They
are explored from left to right in the tropical semiring: a state's arcs relax states
at most one piece further on, so the active window is as long as the longest piece.
Of a merging model all paths that the acceptor lets pass to one position end in the
same piece (merging has one result for each prefix), so one state a position is enough,
and of a unigram model pieces need not be told apart. What is kept for each position is the last
piece of the least path to it; the path is read backwards from the end. Different
words of a batch of texts are explored side by side, one position at a time, long
ones one after another.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from tidefold.llm import words as W
from tidefold.llm.shared import table, text_batches, tidy

MARK, MARKS, BOUNDARY = "▁", re.compile("▁*[^▁]+|▁+"), re.compile("[^▁]▁")
#: Fixed values of the model format: kinds of models and of pieces.
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
UNKNOWN_COST, UNKNOWN_TEXT = 10.0, " ⁇ "
#: Bytes of the table of words, pairs that are kept, the longest word that is explored beside others, and how many are so at a time.
TABLE_BYTES, PAIRS, WIDE, ABREAST = 64 << 20, 1 << 19, 40, 1 << 14
#: Characters of normalised text whose words are listed at a time.
LISTED = 1 << 20
START, NONE = -1, 0xFFFFFFFF  # no piece before, or a character that is none; the latter among ids


class Normaliser:
    """Longest-match rewriting by the rules of a model file, and its treatment of spaces."""

    def __init__(self, spec, suffix: bool):
        self.fold, self.mark = spec.remove_extra_whitespaces, MARK if spec.escape_whitespaces else " "
        self.before, self.after = (self.mark if spec.add_dummy_prefix and on else "" for on in (not suffix, suffix))
        rules = spec.precompiled_charsmap
        self.units, self.odd = np.zeros(0, np.uint32), None
        if rules:
            size = int.from_bytes(rules[:4], "little")
            self.units, self.spelled = np.frombuffer(rules[4 : 4 + size], "<u4").tolist(), rules[4 + size :]
            plain = [c for c in map(chr, range(128)) if self._longest(c.encode()) is None and all(self._longest((c + d).encode()) is None for d in map(chr, range(128)))]
            plain = "".join(map(re.escape, plain))
            self.odd = re.compile(f"[^{plain}]|.(?=[^\x00-\x7f])" if plain else ".", re.DOTALL)

    def _longest(self, data: bytes) -> tuple[str, int] | None:
        """(what is written, how many characters are read) of the longest rule that data begins with. Rules lie in a double array."""
        at, found = self._offset(self.units[0]), None
        for i, byte in enumerate(data):
            at ^= byte
            unit = self.units[at] if at < len(self.units) else 0
            if unit & 0x800000FF != byte:
                break
            at ^= self._offset(unit)
            if unit >> 8 & 1:
                found = self.units[at] & 0x7FFFFFFF, i + 1
        if found is None:
            return None
        return self.spelled[found[0] : self.spelled.index(b"\0", found[0])].decode(), len(data[: found[1]].decode())

    @staticmethod
    def _offset(unit: int) -> int:
        return unit >> 10 << ((unit & 512) >> 6)

    def __call__(self, text: str) -> str:
        if self.odd is not None:
            out, at = [], 0
            while m := self.odd.search(text, at):
                made, read = self._longest(text[m.start() : m.start() + 32].encode()) or (m[0], 1)
                out += [text[at : m.start()], made]
                at = m.start() + read
            text = "".join([*out, text[at:]])
        if self.fold:
            text = re.sub(" +", " ", text).strip(" ")
        return self.before + text.replace(" ", self.mark) + self.after if text else ""


class Numbers:
    """A table from numbers (0 and more, below 2^63) to numbers, for many at a time: open addressing, at most half full."""

    def __init__(self, most: int):
        self.most, self.mask = most, (1 << (2 * most).bit_length()) - 1
        self.clear()

    def clear(self) -> None:
        self.keys, self.values, self.held = np.full(self.mask + 1, -1, np.int64), np.zeros(self.mask + 1, np.int32), 0

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (W.mix(keys.astype(np.uint64)) & np.uint64(self.mask)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The values, -1 for keys that are not there."""
        slot = self._slots(keys)
        at = self.keys[slot]
        out = np.where(at == keys, self.values[slot], -1)
        more = np.flatnonzero((at != keys) & (at >= 0))
        while len(more):
            slot[more] = (slot[more] + 1) & self.mask
            at = self.keys[slot[more]]
            hit = at == keys[more]
            out[more[hit]] = self.values[slot[more[hit]]]
            more = more[~hit & (at >= 0)]
        return out

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Different keys that are not there yet. A table that would hold more than `most` is emptied before."""
        if self.held + len(keys) > self.most:
            self.clear()
        self.held += len(keys)
        slot = self._slots(keys)
        while len(keys):
            free = self.keys[slot] < 0
            self.keys[slot[free]] = keys[free]
            own = self.keys[slot] == keys
            self.values[slot[own]] = values[own]
            keys, values, slot = keys[~own], values[~own], (slot[~own] + 1) & self.mask


class Transducer:
    """A compiled model. Raises ValueError for models of words or characters, and for those with pieces of one's own or unused ones."""

    def __init__(self, model):
        trainer = model.trainer_spec
        if trainer.model_type not in (UNIGRAM, BPE) or any(p.type not in (NORMAL, UNKNOWN, CONTROL, BYTE) for p in model.pieces):
            raise ValueError("only unigram and merging models without pieces of one's own and unused pieces are compiled")
        self.normal = Normaliser(model.normalizer_spec, trainer.treat_whitespace_as_suffix)
        self.merging = trainer.model_type == BPE
        self.pieces = [p.piece for p in model.pieces]
        self.score = {p.piece: p.score for p in model.pieces if p.type == NORMAL}
        self.cost = [-p.score for p in model.pieces]
        self.unknown_cost = UNKNOWN_COST - min(self.score.values(), default=0.0)
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == UNKNOWN)
        own = {int(p.piece[1:-1], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
        self.bytes = own if len(own) == 256 and trainer.byte_fallback else {}
        self.step, self.final = {}, [-1]
        for i, p in enumerate(model.pieces):
            if p.type == NORMAL:
                self._add(p.piece, i)
        self.alone = set(filter(lambda p: len(p) == 1, self.score))
        #: Pieces that go over no boundary of words allow each word to be encoded for itself.
        self.by_words = MARK in self.alone and not any(MARK in p.lstrip(MARK) for p in self.score)
        self.spelled = [b"" if p.type == CONTROL else p.piece.replace(MARK, " ").encode() for p in model.pieces]
        for b, i in own.items():
            self.spelled[i] = bytes([b])
        self.spelled[self.unknown] = UNKNOWN_TEXT.encode()
        chars = sorted(self.alone)
        self.classes = np.zeros(0x110000, np.int32)
        self.classes[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.arcs = self._arcs(len(chars) + 1)
        self.final_of, self.cost_of = np.array(self.final, np.int32), np.array(self.cost)
        self.lengths = np.array([*(len(p) for p in self.pieces), 1])  # START is the last
        self.edges: dict[int, tuple | None] = {}
        self.forget()

    def _add(self, piece: str, i: int) -> None:
        node = 0
        for c in piece:
            key = node << 21 | ord(c)
            if key not in self.step:
                self.step[key] = len(self.final)
                self.final.append(-1)
            node = self.step[key]
        self.final[node] = i

    def _merges(self, text: str) -> Iterator[tuple[float, list[str]]]:
        """Merging of a short string: again and again the pair of best score, the first of equals. Each score, and what is there then."""
        parts = list(text)
        while True:
            best = max(((self.score[x], -i) for i in range(len(parts) - 1) if (x := parts[i] + parts[i + 1]) in self.score), default=None)
            if best is None:
                return
            parts[-best[1] : 2 - best[1]] = [parts[-best[1]] + parts[1 - best[1]]]
            yield best[0], parts

    def _edges(self, i: int) -> tuple | None:
        """What stands first and last in a piece while it is merged, each with the score that made it and a last one of minus infinity.

        None if merging doesn't give the piece; empty if its scores don't fall, so that the order of its merges isn't theirs.
        """
        if i not in self.edges:
            piece, low, falling = self.pieces[i], math.inf, True
            firsts, lasts, parts = [(math.inf, piece[0])], [(math.inf, piece[-1])], list(piece)
            for score, parts in self._merges(piece):
                falling, low = falling and score <= low, score
                if parts[0] != firsts[-1][1]:
                    firsts.append((score, parts[0]))
                if parts[-1] != lasts[-1][1]:
                    lasts.append((score, parts[-1]))
            end = (-math.inf, "")
            self.edges[i] = None if parts != [piece] and len(piece) > 1 else ((*firsts, end), (*lasts, end)) if falling else ()
        return self.edges[i]

    def _arcs(self, classes: int) -> Numbers:
        """The lexicon's arcs between characters that are pieces themselves: number of node and class to where they lead."""
        found = [(key >> 21, c, to) for key, to in self.step.items() if (c := int(self.classes[key & 0x1FFFFF]))]
        rows, self.n_classes = np.array(found, np.int64).reshape(-1, 3), classes
        out = Numbers(len(rows))
        out.add(rows[:, 0] * classes + rows[:, 1], rows[:, 2])
        return out

    def _passes(self, first: int, second: int) -> bool:
        """Whether the acceptor lets a piece follow another, or START: whether merging what they spell gives them again.

        Both are merged in order of scores, until what stands last in the first and first
        in the second would be merged before either goes on.
        """
        one, two = self._edges(second) if first == START else self._edges(first), self._edges(second)
        if one is None or two is None or first == START:
            return two is not None
        if not one or not two:
            spelled = [self.pieces[first], self.pieces[second]]
            parts = list("".join(spelled))
            for _, parts in self._merges("".join(spelled)):
                pass
            return parts == spelled
        (lasts, firsts), i, j, score = (one[1], two[0]), 0, 0, self.score
        while True:
            across = score.get(lasts[i][1] + firsts[j][1])
            a, b = lasts[i + 1][0], firsts[j + 1][0]
            if across is not None and across > a and across >= b:
                return False
            if a == b == -math.inf:
                return True
            i, j = (i + 1, j) if a >= b else (i, j + 1)

    def _all_pass(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        keys = (first.astype(np.int64) + 1) << 32 | second
        found = self.pairs.get(keys)
        new = found < 0
        if new.any():
            more = np.unique(keys[new])
            let = np.fromiter((self._passes((k >> 32) - 1, k & 0xFFFFFFFF) for k in more.tolist()), np.int32, len(more))
            found[new] = let[np.searchsorted(more, keys[new])]
            self.pairs.add(more, let)
        return found > 0

    def _path(self, text: str) -> bytes:
        """The ids along the least path over a normalised text, as little-endian unsigned 32-bit numbers."""
        step, final, cost, merging, alone, seen = self.step, self.final, self.cost, self.merging, self.alone, {}
        n, back = len(text), array("i", bytes(4 * (len(text) + 1)))
        ahead = {0: (0.0, START)}
        for at in range(n):
            here = ahead.pop(at, None)
            if here is None:
                back[at] = -2
                continue
            weight, last = here
            back[at] = last
            node, end = 0, at
            while end < n and (node := step.get(node << 21 | ord(text[end]), 0)):
                end += 1
                piece = final[node]
                if piece >= 0 and merging and (last, piece) not in seen:
                    if len(seen) >= PAIRS // 8:
                        seen.clear()
                    seen[last, piece] = self._passes(last, piece)
                if piece >= 0 and (not merging or seen[last, piece]):
                    w = weight + cost[piece]
                    if end not in ahead or w < ahead[end][0]:
                        ahead[end] = w, piece
            if text[at] not in alone:
                w = weight + self.unknown_cost
                if at + 1 not in ahead or w < ahead[at + 1][0]:
                    ahead[at + 1] = w, START
        back[n] = ahead[n][1] if n else START
        out, at = array("I"), n
        while at:
            piece = back[at]
            if piece >= 0:
                out.append(piece)
                at -= len(self.pieces[piece])
            else:
                at -= 1
                if self.bytes:
                    out.extend(self.bytes[b] for b in reversed(text[at].encode()))
                elif not at or back[at] != START:  # unknown characters in a row have one id
                    out.append(self.unknown)
        out.reverse()
        return out.tobytes()

    def _paths(self, words: list[str]) -> list[bytes]:
        """As _path() of each word, none of them empty."""
        lens = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.cumsum(lens) - lens
        flat = self.classes[np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)]
        fit = lens <= WIDE
        out = [b""] * len(words)
        for i in np.flatnonzero(~fit):
            out[i] = self._path(words[i])
        rows = np.flatnonzero(fit)
        rows = rows[np.argsort(-lens[rows], kind="stable")]
        for at in range(0, len(rows), ABREAST):
            part = rows[at : at + ABREAST]
            ids, ends = self._abreast(flat, starts[part], lens[part])
            for i, start, end in zip(part.tolist(), [0, *ends], ends):
                out[i] = ids[4 * start : 4 * end]
        for i in np.unique(np.searchsorted(starts, np.flatnonzero(flat == 0), side="right") - 1).tolist():
            if fit[i]:
                out[i] = self._filled(out[i], words[i])
        return out

    def _filled(self, ids: bytes, word: str) -> bytes:
        """Ids with NONE replaced by what stands for a word's characters that are no pieces."""
        out, odd, last = array("I"), iter([c for c in word if c not in self.alone]), 0
        for i in memoryview(ids).cast("I"):
            if i != NONE:
                out.append(i)
            elif self.bytes:
                out.extend(self.bytes[b] for b in next(odd).encode())
            elif last != NONE:  # unknown characters in a row have one id
                out.append(self.unknown)
            last = i
        return out.tobytes()

    def _abreast(self, flat: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> tuple[bytes, list[int]]:
        """Least paths of words of falling length, given as classes: all ids in one, and where each word's end."""
        n, longest = len(lens), int(lens[0])
        chars = np.zeros((longest, n), np.int32)
        for j in range(longest):
            here = int(np.searchsorted(-lens, -j))
            chars[j, :here] = flat[starts[:here] + j]
        weight, last = np.full((longest + 1, n), np.inf), np.full((longest + 1, n), START, np.int32)
        weight[0] = 0
        for j in range(longest):
            who = np.flatnonzero(np.isfinite(weight[j, : int(np.searchsorted(-lens, -j))]))
            node, end = np.zeros(len(who), np.int64), j
            odd = who[chars[j, who] == 0]
            less = odd[weight[j, odd] + self.unknown_cost < weight[j + 1, odd]]
            weight[j + 1, less], last[j + 1, less] = weight[j, less] + self.unknown_cost, START
            while len(who) and end < longest:
                c = chars[end, who]
                node = self.arcs.get(node * self.n_classes + c)
                on = np.flatnonzero((node >= 0) & (c > 0))
                who, node, end = who[on], node[on].astype(np.int64), end + 1
                piece = self.final_of[node]
                hit = np.flatnonzero(piece >= 0)
                by, piece = who[hit], piece[hit]
                if self.merging and len(by):
                    let = self._all_pass(last[j, by], piece)
                    by, piece = by[let], piece[let]
                w = weight[j, by] + self.cost_of[piece]
                less = w < weight[end, by]
                weight[end, by[less]], last[end, by[less]] = w[less], piece[less]
        steps, at, rows, count = [], lens.copy(), np.arange(n), np.zeros(n, np.int64)
        while len(rows):
            piece = last[at[rows], rows]
            steps.append((rows, piece))
            count[rows] += 1
            at[rows] -= self.lengths[piece]
            rows = rows[at[rows] > 0]
        ends = np.cumsum(count)
        ids = np.zeros(int(ends[-1]), np.uint32)
        for k, (rows, piece) in enumerate(steps):
            ids[ends[rows] - 1 - k] = piece.view(np.uint32)  # START becomes NONE
        return ids.tobytes(), ends.tolist()

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        texts = [self.normal(t) for t in texts]
        if not self.by_words:
            return [self._path(t) for t in texts]
        out: list[list[bytes]] = [[] for _ in texts]
        held: list[tuple[int, list[str]]] = []
        size = 0
        for i, text in enumerate(texts):
            at = 0
            while at < len(text):
                end = at + LISTED
                cut = BOUNDARY.search(text, end - 1) if end < len(text) else None
                end = cut.start() + 1 if cut else len(text)
                held.append((i, MARKS.findall(text, at, end)))
                size, at = size + end - at, end
                if size >= LISTED:
                    self._take(held, out)
                    held, size = [], 0
        self._take(held, out)
        return [b"".join(parts) for parts in out]

    def _take(self, held: list[tuple[int, list[str]]], out: list[list[bytes]]) -> None:
        if self.held > TABLE_BYTES:
            self.words, self.held = {}, 0
        known = self.words
        new = list({w for _, ws in held for w in ws if w not in known})
        for w, ids in zip(new, self._paths(new)):
            known[w] = ids
            self.held += 230 + 4 * len(w) + len(ids)
        for i, ws in held:
            out[i].append(b"".join(map(known.__getitem__, ws)))

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids: bytes) -> bytes:
        """The text, without the mark that was put in front; where spaces are folded, without any in front. A mark put at the end stays, as in the library."""
        ids, normal = memoryview(ids).cast("I"), self.normal
        parts = list(map(self.spelled.__getitem__, ids))
        if normal.before or normal.after or normal.fold:
            for i, piece in enumerate(ids):
                if piece == self.unknown or parts[i][:1] != b" ":
                    break
                parts[i] = parts[i][1:]
                if parts[i] or not normal.fold:
                    break
        return b"".join(parts)

    def forget(self) -> None:
        """Empty the tables."""
        self.words: dict[str, bytes] = {}
        self.held = 0
        self.pairs = Numbers(PAIRS)


_loaded: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    if path not in _loaded:
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        _loaded[path] = Transducer(model)
    return _loaded[path]


def _mapped(batches: Iterator[pa.RecordBatch], column: str, path: str, make) -> Iterator[tuple[pa.RecordBatch, int, list]]:
    """Parts of batches of about a MB of texts or ids, the column's place, and what make (transducer, values) gives for its values."""
    t = transducer(path)
    for batch in batches:
        at = batch.schema.get_field_index(column)
        for rows, values in W.batches(batch, column, 1 << 20):
            yield batch.slice(rows.start, rows.stop - rows.start), at, make(t, values)
    t.forget()
    tidy()


def _encoded(t: Transducer, values: list[bytes | None]) -> list[bytes | None]:
    found = iter(t.encode_all([v.decode() for v in values if v is not None]))
    return [None if v is None else next(found) for v in values]


def _decoded(t: Transducer, values: list[bytes | None]) -> list[str | None]:
    return [None if v is None else t.decode(v).decode(errors="replace") for v in values]


def _replaced(docs: DataFrame, column: str, kind) -> StructType:
    return StructType([StructField(column, kind()) if f.name == column else f for f in docs.schema])


def encode(docs: DataFrame, model: str, text_col: str = "text") -> DataFrame:
    """docs with its text column replaced by ids: little-endian unsigned 32-bit numbers in a binary column.

    model: path of a piece model, unigram or merging, without pieces of one's own (else
    ValueError on the executors). Null stays null, the empty text has no ids. Of a text,
    however long, a few bytes a character are held besides it; unigram weights are
    added in double precision. Of equal paths that of the longest last piece wins. All other columns and
    all rows, repeated ones too, stay as they are; an empty table gives an empty table.
    Sets the session's Arrow batches to 1000 rows at most.
    """
    text_batches(docs.sparkSession)

    def run(batches):
        for part, at, made in _mapped(batches, text_col, model, _encoded):
            yield part.set_column(at, pa.field(text_col, pa.binary()), pa.array(made, pa.binary()))

    return docs.mapInArrow(run, _replaced(docs, text_col, BinaryType))


def decode(docs: DataFrame, model: str, ids_col: str = "text") -> DataFrame:
    """The reverse of encode(): ids to text. Null stays null; bytes that are no UTF-8 become replacement characters.

    Other columns and all rows stay as they are; an empty table gives an empty table.
    """
    text_batches(docs.sparkSession)

    def run(batches):
        for part, at, made in _mapped(batches, ids_col, model, _decoded):
            yield part.set_column(at, pa.field(ids_col, pa.string()), pa.array(made, pa.string()))

    return docs.mapInArrow(run, _replaced(docs, ids_col, StringType))


def round_trip(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, decoded): every text encoded as by encode() and decoded again as by decode(), in one pass. Null stays null; other columns are not looked at."""
    text_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def run(batches):
        for part, _, ids in _mapped(batches, "text", model, _encoded):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary()), pa.array(_decoded(transducer(model), ids), pa.string())], names=["id", "ids", "decoded"])

    return docs.mapInArrow(run, "id long, ids binary, decoded string")


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op5(spark, sf_dir: str) -> DataFrame:
    both = round_trip(table(spark, sf_dir, "documents"), model_path())
    return both.select(F.col("id").alias("doc_id"), F.expr("octet_length(ids) div 4").alias("n_ids"), F.crc32("ids").alias("ids_crc32"), F.sha2("decoded", 256).alias("decoded_sha256"))
