"""SentencePiece encoding and decoding by one pass over an Aho-Corasick automaton.

The automaton holds every normal piece of the model.  It reads a text once; at each end it
follows the output links, longest piece first, and keeps for the text up to there the best last
piece.  What "best" means depends on the model:

* type UNIGRAM: the greatest sum of piece scores, the usual Viterbi rule; a character without a
  piece of its own costs the least score less ten;
* type BPE (the public model at hand): scores are only ranks of merges, and their greatest sum is
  not what the model encodes ("the" would become "t" + "he").  There a piece is taken if merging
  leaves it and the piece before it apart.  A sequence is the encoding of a text just if all its
  neighbours are such pairs, so exactly one piece is left at each end, and the result equals
  SentencePiece's.

Unknown characters become UTF-8 byte pieces.  Space becomes U+2581 and one is put in front of a
non-empty text.  No piece has U+2581 behind another character (checked when the model is loaded),
so a text falls apart before each run of them, and around line breaks and tabs where no piece
holds these.  Segments that come again are taken from a table of at most ``REMEMBERED`` segments
a worker, of which ``KEPT`` outlive a task.

Defined results: null and empty texts have no ids; U+2581 in a text decodes as a space, as in
SentencePiece.  Models with a character map or without byte pieces are refused.
"""

from __future__ import annotations

import re
from itertools import chain, islice

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from sentencepiece import sentencepiece_model_pb2 as proto

from timeweave.llm.registry import query
from timeweave.llm.tables import read
from timeweave.llm.words import slices

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
UNKNOWN_PENALTY = 10.0
LOWEST = -np.inf
BETWEEN = "\0"
REMEMBERED = 400_000
KEPT = 100_000
BLOCK_CELLS = 200_000
VERDICTS = 1 << 21
SCATTER = np.int64(-7046029254386353131)  # an odd number whose multiples' upper bits are well spread
ADDED = ("token_ids", "n_tokens", "decoded_text")
NORMAL, BYTE = 1, 6
BPE_TYPE = 2
START, UNKNOWN = -2, -1
MATCH = np.dtype([("last", np.int64), ("piece", np.int64)])


class Pieces:
    """The automaton and the piece tables of one model."""

    def __init__(self, serialised: bytes):
        model = proto.ModelProto()
        model.ParseFromString(serialised)
        spec = model.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix:
            raise ValueError("only models with a dummy prefix and no other normalisation are supported")
        self.bytes_of, self.byte_ids = [], {}
        self.automaton = ahocorasick.Automaton()
        known = set()
        for i, piece in enumerate(model.pieces):
            if piece.type == BYTE:
                value = int(piece.piece[3:-1], 16)
                self.byte_ids[value] = i
                self.bytes_of.append(bytes([value]))
                continue
            self.bytes_of.append(piece.piece.encode() if piece.type == NORMAL else b"")
            if piece.type == NORMAL:
                if SPACE in piece.piece.lstrip(SPACE):
                    raise ValueError(f"piece {i} spans words")
                self.automaton.add_word(piece.piece, i)
                known.update(piece.piece)
        if len(self.byte_ids) != 256 or BETWEEN in known:
            raise ValueError("the model has no byte pieces")
        self.automaton.make_automaton()
        self.rank = {piece.piece: piece.score for piece in model.pieces if piece.type == NORMAL}
        self.by_merging = model.trainer_spec.model_type == BPE_TYPE
        self.text_of = [piece.piece for piece in model.pieces]
        self.length = np.array([len(piece.piece) for piece in model.pieces])
        self.score = np.array([piece.score for piece in model.pieces])
        self.unknown = min(piece.score for piece in model.pieces if piece.type == NORMAL) - UNKNOWN_PENALTY
        apart = "".join(c for c in "\n\r\t" if c not in known)
        self.segments = re.compile(f"{SPACE}*[^{SPACE}{apart}]+|{SPACE}+" + (f"|[{apart}]" if apart else ""))
        self.forget()

    def forget(self) -> None:
        self.remembered: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        # Verdicts on pairs, each in the one slot of its key: twice the key, and one more if they stay apart.
        self.apart = np.full(VERDICTS, -1, np.int64)

    def stays_apart(self, before: int, piece: int) -> bool:
        """Whether merging the characters of two pieces ends with these two (or, at the start, this one)."""
        left = self.text_of[before] if before >= 0 else ""
        symbols, rank = list(left + self.text_of[piece]), self.rank.get
        first = len(left)  # the piece's first symbol
        ranks = [rank(a + b, LOWEST) for a, b in zip(symbols, symbols[1:])]
        while ranks:
            top = max(ranks)
            if top == LOWEST:
                break
            at = ranks.index(top)
            if at + 1 == first:  # a merge across the two
                return False
            first -= at < first
            # Only the merged symbol's neighbours have other ranks than before.
            symbols[at:at + 2] = [symbols[at] + symbols[at + 1]]
            del ranks[at]
            if at < len(ranks):
                ranks[at] = rank(symbols[at] + symbols[at + 1], LOWEST)
            if at:
                ranks[at - 1] = rank(symbols[at - 1] + symbols[at], LOWEST)
        return len(symbols) == (2 if left else 1)

    def compatible(self, before: np.ndarray, piece: np.ndarray) -> np.ndarray:
        keys = (before + 2) * len(self.text_of) + piece
        slots = (keys * SCATTER).view(np.uint64) >> np.uint64(64 - VERDICTS.bit_length() + 1)
        held = self.apart[slots]
        fits = (held & 1).astype(bool)
        new = np.flatnonzero(held >> 1 != keys)
        if len(new):
            asked, of = np.unique(keys[new], return_inverse=True)
            befores, pieces = asked // len(self.text_of) - 2, asked % len(self.text_of)
            found = np.fromiter(map(self.stays_apart, befores.tolist(), pieces.tolist()), bool, len(asked))[of]
            fits[new] = found
            self.apart[slots[new]] = keys[new] * 2 + found
        return fits

    def viterbi(self, segments: list[str]) -> list[bytes]:
        """Ids of many segments as 32-bit integers; they advance together, one character at a time."""
        sizes = np.array([len(x) for x in segments])
        starts = np.cumsum(sizes + 1) - sizes - 1
        found = np.fromiter(self.automaton.iter(BETWEEN.join(segments)), MATCH)
        last, piece = found["last"], found["piece"]
        of = np.searchsorted(starts, last, "right") - 1
        end = last - starts[of] + 1
        order = np.argsort(end, kind="stable")  # within one end by segment, there the longest first
        of, end, piece = of[order], end[order], piece[order]
        upto = np.searchsorted(end, np.arange(sizes.max() + 2))
        best = np.full((sizes.max() + 1, len(sizes)), UNKNOWN)
        best[0] = START
        score = np.full(best.shape, -np.inf) if not self.by_merging else None
        if score is not None:
            score[0] = 0
        for at in range(1, len(best)):
            rows, pieces = of[upto[at]:upto[at + 1]], piece[upto[at]:upto[at + 1]]
            if self.by_merging:
                self._merged(best, at, rows, pieces)
            else:
                self._scored(best, score, at, rows, pieces)
        # Backwards from the ends; a step holds the piece before it in each segment.
        steps, at, rows = [], sizes.copy(), np.flatnonzero(sizes)
        while len(rows):
            taken = best[at[rows], rows]
            steps.append((rows, at[rows], taken))
            at[rows] -= np.where(taken >= 0, self.length[taken], 1)
            rows = rows[at[rows] > 0]
        rows, stop, taken = (np.concatenate(x) for x in zip(*steps)) if steps else (np.zeros(0, int),) * 3
        order = np.lexsort((stop, rows))
        rows, stop, taken = rows[order], stop[order], taken[order].astype(np.int32)
        cuts = np.searchsorted(rows, np.arange(len(segments) + 1))
        flat = taken.tobytes()
        out = [flat[4 * a:4 * b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
        for row in np.unique(rows[taken == UNKNOWN]).tolist():
            ids: list[int] = []
            for i, upto_char in zip(taken[cuts[row]:cuts[row + 1]].tolist(), stop[cuts[row]:cuts[row + 1]].tolist()):
                ids += [i] if i >= 0 else [self.byte_ids[b] for b in segments[row][upto_char - 1].encode()]
            out[row] = np.array(ids, np.int32).tobytes()
        return out

    def _merged(self, best: np.ndarray, at: int, rows: np.ndarray, pieces: np.ndarray) -> None:
        """The one piece of each row that stays apart from the piece before it."""
        open_ = np.flatnonzero(np.diff(rows, prepend=-1))
        while len(open_):
            row, own = rows[open_], pieces[open_]
            fits = self.compatible(best[at - self.length[own], row], own)
            best[at, row[fits]] = own[fits]
            after = open_[~fits] + 1
            after = after[after < len(rows)]
            open_ = after[rows[after] == rows[after - 1]]

    def _scored(self, best: np.ndarray, score: np.ndarray, at: int, rows: np.ndarray, pieces: np.ndarray) -> None:
        """The piece of each row with the greatest sum of scores."""
        single = np.zeros(best.shape[1], bool)
        if len(rows):
            value = score[at - self.length[pieces], rows] + self.score[pieces]
            first = np.flatnonzero(np.diff(rows, prepend=-1))
            top = np.maximum.reduceat(value, first)
            wins = np.where(value == np.repeat(top, np.diff(first, append=len(rows))), np.arange(len(rows)), len(rows))
            score[at, rows[first]] = top
            best[at, rows[first]] = pieces[np.minimum.reduceat(wins, first)]
            single[rows[self.length[pieces] == 1]] = True
        unknown = score[at - 1] + self.unknown
        lone = ~single & (unknown > score[at])
        score[at, lone], best[at, lone] = unknown[lone], UNKNOWN

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text."""
        parts = [self.segments.findall(SPACE + text.replace(" ", SPACE)) if text else [] for text in texts]
        asked = set(chain.from_iterable(parts))
        if len(self.remembered) + len(asked.difference(self.remembered)) > REMEMBERED // 2:
            # What comes again moves on from the older half of the table, the rest is forgotten with it.
            self.older, self.remembered = self.remembered, {}
        self.remembered.update((x, self.older[x]) for x in asked.difference(self.remembered).intersection(self.older))
        new = asked.difference(self.remembered)
        ordered = sorted(new, key=len)
        a = 0
        while a < len(ordered):
            # Blocks of similar length, so that a block's table stays near BLOCK_CELLS cells.
            b = min(len(ordered), a + max(1, BLOCK_CELLS // (len(ordered[a]) + 1)))
            while b > a + 1 and (b - a) * len(ordered[b - 1]) > 4 * BLOCK_CELLS:
                b = a + (b - a) // 2
            self.remembered.update(zip(ordered[a:b], self.viterbi(ordered[a:b])))
            a = b
        get = self.remembered.__getitem__
        return [np.frombuffer(b"".join(map(get, own)), np.int32) for own in parts]

    def decode(self, ids) -> str:
        text = b"".join(map(self.bytes_of.__getitem__, ids.tolist() if isinstance(ids, np.ndarray) else ids)).decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if text.startswith(" ") else text


_LOADED: dict[int, Pieces] = {}


def loaded(serialised: bytes) -> Pieces:
    """One automaton a worker and model."""
    key = hash(serialised)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Pieces(serialised)
    return _LOADED[key]


def encode(df: DataFrame, model: bytes, text: str = "text", with_text: bool = False) -> DataFrame:
    """All rows; ``token_ids`` and ``n_tokens`` are added, and the text decoded from the ids.

    The text column itself is left out unless ``with_text``.  Columns of the added names are replaced.
    """
    df = df.drop(*ADDED)
    keep = [f for f in df.schema.fields if with_text or f.name != text]
    schema = T.StructType([*keep, T.StructField("token_ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType()), T.StructField("decoded_text", T.StringType())])
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        pieces = loaded(shared.value)
        for batch in slices(batches, text):
            ids = pieces.encode(batch.column(text).to_pylist())
            decoded = [pieces.decode(own) for own in ids]
            sizes = np.cumsum([0, *map(len, ids)])
            every = np.concatenate(ids)
            flat = pa.ListArray.from_arrays(pa.array(sizes.astype(np.int32)), pa.array(every))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(f.name) for f in keep), flat, pa.array(np.diff(sizes).astype(np.int64)), pa.array(decoded, pa.string())],
                names=[f.name for f in keep] + list(ADDED),
            )
        # A worker lives on for tasks of other operators; it should hold few segments meanwhile: the first met, often the common ones.
        pieces.older, pieces.remembered = {}, dict(islice(pieces.remembered.items(), KEPT))

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, model: bytes, ids: str = "token_ids") -> DataFrame:
    """All rows and columns with ``decoded_text``; null ids decode to the empty text."""
    df = df.drop("decoded_text")
    schema = T.StructType([*df.schema.fields, T.StructField("decoded_text", T.StringType())])
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        pieces = loaded(shared.value)
        for batch in batches:
            texts = [pieces.decode(own or ()) for own in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded_text"])

    return df.mapInArrow(run, schema)


def load_model(path: str = MODEL_PATH) -> bytes:
    """The serialised model; read on the driver and broadcast (half a megabyte)."""
    with open(path, "rb") as file:
        return file.read()


@query("op4_sentence_pieces")
def op4_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text, and whether they decode to it."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    wanted = F.sha2(F.translate(F.coalesce("text", F.lit("")), SPACE, " "), 256).alias("wanted")
    done = encode(docs.select("doc_id", "text", wanted), load_model())
    return done.select("doc_id", "n_tokens", "token_ids", (F.sha2("decoded_text", 256) == F.col("wanted")).alias("round_trip"))
