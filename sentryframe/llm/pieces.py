"""SentencePiece encoding and decoding by a streaming Viterbi lattice.

The lattice has a node at every character boundary and a piece for every arc.  A sequence of
pieces is what the model's merges give exactly if every two neighbours in it are, and each
prefix has one such sequence; so at each boundary one arc survives: the piece whose left
neighbour, the survivor at the arc's start, forms a valid pair with it.  Only the boundaries
within one maximum piece length are held.  Whenever the backpointer paths of all held
boundaries meet in one boundary, the ids before it are final and are committed.

A pair is valid if merging its own characters gives the pair back; a bounded memory keeps the
answers.  Where no piece of the vocabulary spans two neighbouring characters all paths meet as
well: before a blank mark and, if the vocabulary allows, between a letter and another character.
There the text is cut into words, and a bounded memory keeps the ids of words.  Characters that are no piece become their UTF-8 bytes.

Decoding joins the pieces, reads byte pieces back and drops the blank put before the text.
Texts with the mark U+2581 itself come back with a blank in its place, as the model's own
decoder gives it.  Null text has null ids; empty text has none.  Texts of any length keep
memory bounded by the window plus the ids.  Rows are judged one by one: null ids, ties and
repeated rows come back as they are; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import re
from array import array

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held, map_batches, send, ship

MARK = "▁"
#: Entries of each memory of a task; a full one is emptied, of words the older half.
REMEMBERED = 200_000
#: Words longer than this are not remembered.
LONG_WORD = 64


class Vocabulary:
    """Pieces of a merge model: text, id and rank; byte ids."""

    def __init__(self, model_file: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.unknown = model.unk_id()
        self.text: list[str | None] = []
        self.ids: dict[str, int] = {}
        self.score: dict[str, float] = {}
        self.byte = [self.unknown] * 256
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
                self.text.append(None)
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.text.append("" if model.is_control(i) else "⁇")
            else:
                self.text.append(piece)
                self.ids[piece] = i
                self.score[piece] = model.get_score(i)
        self.longest = max(map(len, self.ids), default=1)
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece holds a blank mark behind another character")
        self.words = self._cuts()

    def _cuts(self) -> re.Pattern:
        """Where a text may be cut: before a blank mark and, if no piece holds a letter and another
        character side by side, between those as well.  Numerals that ``\\w`` takes for letters are not."""
        numerals = "".join(sorted({c for p in self.ids for c in p if c.isalnum() and not c.isalpha() and not c.isdecimal()}))
        letter, other = f"[^\\W\\d_{numerals}]", f"[\\d_{numerals}]|[^\\w{MARK}]"
        if any(re.search(f"{letter}(?:{other})|(?:{other}){letter}", p) for p in self.ids):
            return re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
        return re.compile(f"{MARK}*(?:{letter}+|(?:{other})+)|{MARK}+")


class Encoder:
    """Encodes texts; holds a window of the lattice and bounded memories."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.pairs: dict[tuple[str, str], bool] = {}
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.spines: dict[str, tuple[list, list] | None] = {}
        self.widest = 0
        lengths: dict[str, set[int]] = {}
        for piece in vocabulary.ids:
            if len(piece) >= 4:
                lengths.setdefault(piece[-4:], set()).add(len(piece))
        #: Lengths of the pieces of four characters and more that end in these four.
        self.lengths = {tail: sorted(found, reverse=True) for tail, found in lengths.items()}

    def merged(self, text: str) -> list:
        """Merges of a short text as trees: the best-scored neighbours first, the leftmost of equals."""
        parts, score = [(c, None, None) for c in text], self.v.score
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i][0] + parts[i + 1][0])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                return parts
            parts[at:at + 2] = [(parts[at][0] + parts[at + 1][0], parts[at], parts[at + 1])]

    def spine(self, piece: str) -> tuple[list, list] | None:
        """What stands at the piece's left and right edge while it is merged, with the score of each
        step, outermost last; None for a piece that its own characters do not merge to."""
        if piece not in self.spines:
            trees = self.merged(piece)
            edges = None
            if len(trees) == 1:
                edges = ([], [])
                for side, found in ((1, edges[0]), (2, edges[1])):
                    node = trees[0]
                    while node is not None:
                        found.append((node[0], self.v.score.get(node[0], 0.0)))
                        node = node[side]
                    found.reverse()
            self.spines[piece] = edges
        return self.spines[piece]

    def fits(self, left: str, right: str) -> bool:
        """Whether no merge ever crosses from ``left`` to ``right``: the steps on both edges and the
        merge across compete by score, the leftmost of equals first."""
        edges = self.spine(right)
        if edges is None:
            return False
        if not left:
            return True
        a, b, score = self.spine(left)[1], edges[0], self.v.score
        i = j = 0
        while True:
            across = score.get(a[i][0] + b[j][0])
            step_a = a[i + 1][1] if i + 1 < len(a) else None
            step_b = b[j + 1][1] if j + 1 < len(b) else None
            if across is not None and (step_a is None or across > step_a) and (step_b is None or across >= step_b):
                return False
            if step_a is None and step_b is None:
                return True
            if step_b is None or (step_a is not None and step_a >= step_b):
                i += 1
            else:
                j += 1

    def lattice(self, text: str) -> list[str]:
        """Pieces of a text, committed as soon as the surviving paths meet."""
        ids, longest, pairs, lengths = self.v.ids, self.v.longest, self.pairs, self.lengths
        # The survivor of each boundary from ``done`` on: start of its arc, and its piece.
        starts, names = [0], [""]
        done, out, count = 0, [], len(text)
        for end in range(1, count + 1):
            for size in (*lengths.get(text[end - 4:end], ()), 3, 2, 1) if end > 3 else (3, 2, 1):
                start = end - size
                if start < done:
                    continue
                piece = text[start:end]
                if piece not in ids:
                    continue
                left = names[start - done]
                known = pairs.get((left, piece))
                if known is None:
                    if len(pairs) >= REMEMBERED:
                        pairs.clear()
                    known = pairs[left, piece] = self.fits(left, piece)
                if known:
                    break
            else:  # a character that is no piece: bytes
                start = end - 1
                piece = text[start:end]
            starts.append(start)
            names.append(piece)
            if end - done >= longest + longest or end == count:
                self.widest = max(self.widest, len(starts))
                done = self._commit(starts, names, done, end, out, end == count)
        return out

    def _commit(self, starts: list[int], names: list[str], done: int, end: int, out: list[str], last: bool) -> int:
        """Write what lies before the boundary where the paths of all live boundaries meet."""
        paths = {end} if last else set(range(end - self.v.longest + 1, end + 1))
        while len(paths) > 1:
            top = max(paths)
            paths.remove(top)
            paths.add(starts[top - done])
        meet = at = paths.pop()
        back = []
        while at > done:
            back.append(names[at - done])
            at = starts[at - done]
        out.extend(reversed(back))
        del starts[:meet - done], names[:meet - done]
        return meet

    def word(self, word: str) -> bytes:
        known = self.older.get(word)
        if known is None:
            ids: list[int] = []
            for piece in self.lattice(word):
                i = self.v.ids.get(piece)
                ids.extend([i] if i is not None else (self.v.byte[b] for b in piece.encode("utf-8", "surrogatepass")))
            known = array("i", ids).tobytes()
        if len(word) <= LONG_WORD:
            if len(self.words) >= REMEMBERED:
                self.older, self.words = self.words, {}
            self.words[word] = known
        return known

    def encode(self, text: str) -> bytes:
        """Ids of a text as 32-bit integers."""
        if not text:
            return b""
        word, known = self.word, self.words.get
        return b"".join([known(w) or word(w) for w in self.v.words.findall(MARK + text.replace(" ", MARK))])


class Decoder:
    def __init__(self, vocabulary: Vocabulary):
        self.raw = [b"" if t is None else t.encode().replace(MARK.encode(), b" ") for t in vocabulary.text]
        for byte, i in enumerate(vocabulary.byte):
            if i != vocabulary.unknown:
                self.raw[i] = bytes([byte])

    def decode(self, ids: list[int]) -> str:
        whole = b"".join(map(self.raw.__getitem__, ids))
        return (whole[1:] if whole[:1] == b" " else whole).decode("utf-8", "replace")


def _encode_run(sent):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        # A worker keeps the broadcast object, and with it the memories, from task to task.
        encoder, parts, offsets, missing = held(sent), [], [0], []
        for value in batch.column(1):
            text = value.as_py()
            ids = b"" if text is None else encoder.encode(text)
            missing.append(text is None)
            parts.append(ids)
            offsets.append(offsets[-1] + len(ids) // 4)
        flat = pa.Array.from_buffers(pa.int32(), offsets[-1], [None, pa.py_buffer(b"".join(parts))])
        starts = pa.array([None if i < len(missing) and missing[i] else o for i, o in enumerate(offsets)], pa.int32())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(starts, flat)], ["kept", "ids"])

    return run


def _decode_run(sent):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [None if not x.is_valid else held(sent).decode(x.values.to_numpy().tolist()) for x in batch.column(1)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["kept", "decoded"])

    return run


def _over(df: DataFrame, keep: tuple[str, ...], column: str, run, out: str) -> DataFrame:
    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("kept"), F.col(f"`{column}`").alias("body"))
    kept_type = rows.schema["kept"].dataType.simpleString()
    name = out.split()[0]
    return map_batches(rows, run, f"kept {kept_type}, {out}").select(*(F.col("kept")[c].alias(c) for c in keep), name)


def encode(docs: DataFrame, model_file: str, *, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The ``keep`` columns and ``ids``.  The driver reads the model file and sends its pieces."""
    sent = send(docs.sparkSession, Encoder(Vocabulary(model_file)))
    return _over(docs, keep, text, _encode_run(sent), "ids array<int>")


def decode(rows: DataFrame, model_file: str, *, keep: tuple[str, ...] = ("doc_id",), ids: str = "ids") -> DataFrame:
    """The ``keep`` columns and ``decoded``."""
    sent = send(rows.sparkSession, Decoder(Vocabulary(model_file)))
    return _over(rows, keep, ids, _decode_run(sent), "decoded string")


ship(__name__)
