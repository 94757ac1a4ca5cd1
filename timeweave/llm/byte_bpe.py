"""Byte-level BPE by a lazily determinised finite-state transducer, and decoding as a stream.

A sequence of tokens is the encoding of its bytes just if every two neighbours are what merging makes of
their bytes together.  That makes a finite-state machine: a thread has read whole tokens, each fitting the
one before, and stands at a node of the vocabulary's trie inside the next token.  The machine is
nondeterministic, as many tokens may be open at once; its threads are determinised as they are met: a state
is the list of open threads, each with the tokens not yet certain and its trie node.  After each byte exactly one
thread ends a token there.  Tokens that all open threads have in common are certain and are emitted with
the transition, so the output lags by no more than the bytes that some token can still cover.  Transitions
are computed once and kept, at most ``MOST_STATES`` states; then the tables start anew.

A match of the splitting pattern that is a token itself is that token, as in the tiktoken library.  Matches
that come again are taken from a table of at most ``REMEMBERED`` short matches a worker.

Decoding feeds tokens to an incremental UTF-8 machine whose state is the unfinished code point; what a
token does in a state is kept.  Bytes that are no UTF-8 become U+FFFD by the usual rule of maximal parts.

Tokens are packed as little-endian unsigned 32-bit integers, the usual form of token files.

Defined results: null and empty texts have no tokens; null token strings decode to the empty text; an id
outside the vocabulary raises; columns with the names of the added ones are replaced, all others stay.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timeweave.llm.registry import query
from timeweave.llm.tables import read
from timeweave.llm.words import slices

MOST_STATES = 3 << 17
REMEMBERED = 1 << 19
SHORT = 64
MOST_UNFINISHED = 1 << 12
LONG_TEXT = 1 << 20
MATCHES = 1 << 16
START, ROOT, NONE, NEVER = -1, 0, -1, 1 << 32
BAD = "�"
# The second byte after these leads has a smaller range than 80 to BF.
SECOND = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}


class Transducer:
    """States are (last emitted token, ((uncertain tokens, trie node), …)), the longest open token first."""

    def __init__(self, tokens: dict[bytes, int]):
        if any(bytes([b]) not in tokens for b in range(256)):
            raise ValueError("every byte must be a token")
        self.ids = tokens
        self.bytes_of = {i: token for token, i in tokens.items()}
        self.child: dict[int, int] = {}
        self.token_at = [NONE]
        for token, i in tokens.items():
            node = ROOT
            for byte in token:
                key = node << 8 | byte
                node = self.child.get(key, NONE)
                if node == NONE:
                    node = self.child[key] = len(self.token_at)
                    self.token_at.append(NONE)
            self.token_at[node] = i
        self.inner = bytearray(len(self.token_at))
        for key in self.child:
            self.inner[key >> 8] = 1
        self.known: dict[int, bool] = {}
        self.spines: dict[tuple[int, int], list[int] | None] = {}
        self.forget()

    def forget(self) -> None:
        self.states: list[tuple] = []
        self.numbers: dict[tuple[int, tuple], int] = {}
        self.moves: dict[int, tuple[int, bytes]] = {}
        self.number(START, (((), ROOT),))

    def number(self, last: int, threads: tuple) -> int:
        """The number of a state; the last emitted token and the uncertain ones after it tell all of it."""
        key = last, threads[-1][0]
        at = self.numbers.get(key)
        if at is None:
            at = self.numbers[key] = len(self.states)
            self.states.append((last, threads))
        return at

    def merged(self, data: bytes, below: float) -> list[int]:
        """What is left of some bytes after all merges that rank before ``below``."""
        symbols = [bytes([b]) for b in data]
        while len(symbols) > 1:
            ranks = [self.ids.get(a + b, below) for a, b in zip(symbols, symbols[1:])]
            least = min(ranks)
            if least >= below:
                break
            at = ranks.index(least)
            symbols[at:at + 2] = [symbols[at] + symbols[at + 1]]
        return [self.ids[symbol] for symbol in symbols]

    def spine(self, token: int, side: int) -> list[int] | None:
        """The tokens that stand at the left (0) or right (-1) edge while a token is merged, from its byte on.

        None if merging its bytes does not end with the token.
        """
        key = token, side
        if key not in self.spines:
            data = self.bytes_of[token]
            parts = self.merged(data, token) if len(data) > 1 else []
            below = self.spine(parts[side], side) if len(parts) == 2 else [] if len(data) == 1 else None
            self.spines[key] = None if below is None or len(parts) == 2 and self.pair(*parts) != token else [*below, token]
        return self.spines[key]

    def pair(self, left: int, right: int) -> int:
        return self.ids.get(self.bytes_of[left] + self.bytes_of[right], NEVER)

    def fits(self, before: int, token: int) -> bool:
        """Whether merging the bytes of two tokens ends with these two (or, at the start, with this one).

        Each side merges as it would alone until the two symbols that meet at the edge merge first; of
        equal merges the leftmost comes first.
        """
        key = before << 20 | token
        answer = self.known.get(key)
        if answer is None:
            right = self.spine(token, 0)
            left = right and (self.spine(before, -1) if before != START else [])
            answer = bool(right) and left is not None
            i = j = 0
            while answer and left:
                next_left = left[i + 1] if i + 1 < len(left) else NEVER
                next_right = right[j + 1] if j + 1 < len(right) else NEVER
                across = self.pair(left[i], right[j])
                if across < next_left and across <= next_right:
                    answer = False
                elif next_left == next_right == NEVER:
                    break
                elif next_left <= next_right:
                    i += 1
                else:
                    j += 1
            if len(self.known) >= 1 << 20:
                self.known.clear()
            self.known[key] = answer
        return answer

    def move(self, at: int, byte: int) -> tuple[int, bytes]:
        """The state after one more byte and the packed tokens that are certain then; the transition is kept."""
        last, threads = self.states[at]
        get, token_at, inner, known = self.child.get, self.token_at, self.inner, self.known
        open_, ended = [], None
        for thread in threads:
            chain, node = thread
            node = get(node << 8 | byte)
            if node is None:
                continue
            if ended is None and (token := token_at[node]) != NONE:
                before = chain[-1] if chain else last
                answer = known.get(before << 20 | token)
                if self.fits(before, token) if answer is None else answer:
                    ended = (*chain, token)
            if inner[node]:
                open_.append((chain, node))
        certain = len(ended)
        for chain, _ in open_:
            if len(chain) < certain:
                certain = len(chain)
            while chain[:certain] != ended[:certain]:
                certain -= 1
        packed = b""
        if certain:
            packed, last, ended = pack(ended[:certain]), ended[certain - 1], ended[certain:]
            open_ = [(chain[certain:], node) for chain, node in open_]
        to = self.numbers.get((last, ended))
        if to is None:
            open_.append((ended, ROOT))
            if len(self.states) >= MOST_STATES:
                self.forget()
                return self.number(last, tuple(open_)), packed
            to = self.number(last, tuple(open_))
        hit = self.moves[at << 8 | byte] = (to, packed)
        return hit

    def finish(self, at: int, byte: int) -> bytes:
        """The packed tokens still owed when the input ends with this byte; no state is made for that."""
        last, threads = self.states[at]
        for chain, node in threads:
            token = self.token_at[self.child.get(node << 8 | byte, ROOT)]
            if token != NONE:
                if last == START and not chain:
                    return pack((token,))  # the whole match is one token
                if self.fits(chain[-1] if chain else last, token):
                    return pack((*chain, token))
        raise AssertionError("every byte is a token")

    def encode(self, data: bytes) -> bytes:
        """Packed tokens of one match of the splitting pattern."""
        if not data:
            return b""
        moves, at, out = self.moves, 0, []
        for byte in data[:-1]:
            hit = moves.get(at << 8 | byte)
            if hit is None:
                hit = self.move(at, byte)
                moves = self.moves
            at = hit[0]
            if hit[1]:
                out.append(hit[1])
        out.append(self.finish(at, data[-1]))
        return b"".join(out)


def pack(ids: tuple[int, ...]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def step(pending: bytes, byte: int) -> tuple[str, bytes]:
    """The UTF-8 machine: text that one more byte completes, and the code point left unfinished."""
    if not pending:
        if byte < 0x80:
            return chr(byte), b""
        return ("", bytes([byte])) if 0xC2 <= byte <= 0xF4 else (BAD, b"")
    lead = pending[0]
    low, high = SECOND.get(lead, (0x80, 0xBF)) if len(pending) == 1 else (0x80, 0xBF)
    if not low <= byte <= high:
        text, left = step(b"", byte)
        return BAD + text, left
    size = 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
    if len(pending) + 1 < size:
        return "", pending + bytes([byte])
    point = lead & (0x7F >> size)
    for b in (*pending[1:], byte):
        point = point << 6 | b & 0x3F
    return chr(point), b""


class Unfinished(dict):
    """What tokens do while a code point is unfinished: their text, and the state they leave."""

    def __init__(self, pending: bytes):
        super().__init__()
        self.pending = pending


class StreamDecoder:
    """Text from tokens as they come; ``feed`` returns what is complete, ``close`` what is left."""

    def __init__(self, bytes_of: dict[int, bytes], states: dict[bytes, Unfinished] | None = None):
        self.bytes_of = bytes_of
        self.states = {} if states is None else states
        self.at = self.state(b"")

    def state(self, pending: bytes) -> Unfinished:
        if pending not in self.states:
            if len(self.states) >= MOST_UNFINISHED:
                self.states.clear()
            self.states[pending] = Unfinished(pending)
        return self.states[pending]

    def feed(self, ids) -> str:
        at, out = self.at, []
        for i in ids:
            hit = at.get(i)
            if hit is None:
                text, left = "", at.pending
                for byte in self.bytes_of[i]:
                    more, left = step(left, byte)
                    text += more
                hit = at[i] = (text, self.state(left))
            out.append(hit[0])
            at = hit[1]
        self.at = at
        return "".join(out)

    def close(self) -> str:
        left, self.at = self.at.pending, self.state(b"")
        return BAD if left else ""


class Matches(dict):
    """Packed tokens of matches; those that are missing go through the transducer."""

    def __init__(self, machine: Transducer):
        super().__init__()
        self.machine = machine

    def __missing__(self, match: str) -> bytes:
        packed = self.machine.encode(match.encode())
        if len(match) <= SHORT:
            if len(self) >= REMEMBERED:
                self.clear()
            self[match] = packed
        return packed


class Codec:
    """One vocabulary file with its splitting pattern."""

    def __init__(self, ranks: bytes, pattern: str):
        pairs = (line.split() for line in ranks.splitlines() if line.strip())
        self.machine = Transducer({base64.b64decode(token): int(rank) for token, rank in pairs})
        self.split = regex.compile(pattern)
        self.matches = Matches(self.machine)
        self.unfinished: dict[bytes, Unfinished] = {}

    def encode(self, text: str | None) -> bytes:
        get = self.matches.__getitem__
        if not text:
            return b""
        if len(text) <= LONG_TEXT:
            return b"".join(map(get, self.split.findall(text)))
        found, out = (m.group() for m in self.split.finditer(text)), []
        while some := b"".join(map(get, islice(found, MATCHES))):
            out.append(some)
        return b"".join(out)

    def decode(self, packed: bytes | None) -> str:
        stream = StreamDecoder(self.machine.bytes_of, self.unfinished)
        return stream.feed(memoryview(packed or b"").cast("I")) + stream.close()


_LOADED: dict[str, tuple[tuple[bytes, str], Codec]] = {}


def loaded(model: tuple[bytes, str]) -> Codec:
    """One codec a worker, made anew for another model."""
    held = _LOADED.get("codec")
    if held is None or held[0] != model:
        held = _LOADED["codec"] = (model, Codec(*model))
    return held[1]


def load_model(path: str | None = None, pattern: str | None = None) -> tuple[bytes, str]:
    """The rank file and its pattern, read on the driver and broadcast (under a megabyte)."""
    import public_tokenizers

    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        return file.read(), pattern or public_tokenizers.PATTERN


def _added(df: DataFrame, needs: str, keep: list[T.StructField], fields: list[T.StructField], model: tuple[bytes, str], columns) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(model)
    packed = df.select(F.struct(*[F.col(f"`{f.name}`") for f in keep]).alias("kept"), F.col(needs).alias("needed"))
    schema = T.StructType([packed.schema["kept"], *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = loaded(shared.value)
        for batch in slices(batches, "needed"):
            yield pa.RecordBatch.from_arrays([batch.column("kept"), *columns(codec, batch.column("needed").to_pylist())], names=schema.names)

    done = packed.mapInArrow(run, schema)
    return done.select(*[F.col("kept")[f.name].alias(f.name) for f in keep], *[f.name for f in fields])


def encode(df: DataFrame, model: tuple[bytes, str], text: str = "text", with_text: bool = False, with_decoded: bool = False) -> DataFrame:
    """All rows with ``tokens`` (packed) and ``n_tokens``; ``decoded_text`` in the same pass on demand.

    The text column itself is left out unless ``with_text``.
    """
    fields = [T.StructField("tokens", T.BinaryType()), T.StructField("n_tokens", T.LongType())]
    fields += [T.StructField("decoded_text", T.StringType())] if with_decoded else []
    added = {f.name for f in fields}
    keep = [f for f in df.schema.fields if f.name not in added and (with_text or f.name != text)]

    def columns(codec: Codec, texts: list[str | None]) -> list[pa.Array]:
        packed = [codec.encode(t) for t in texts]
        out = [pa.array(packed, pa.binary()), pa.array([len(p) // 4 for p in packed], pa.int64())]
        return out + ([pa.array([codec.decode(p) for p in packed], pa.string())] if with_decoded else [])

    return _added(df, text, keep, fields, model, columns)


def decode(df: DataFrame, model: tuple[bytes, str], tokens: str = "tokens") -> DataFrame:
    """All rows and columns with ``decoded_text``."""
    keep = [f for f in df.schema.fields if f.name != "decoded_text"]
    field = T.StructField("decoded_text", T.StringType())
    return _added(df, tokens, keep, [field], model, lambda codec, packed: [pa.array([codec.decode(p) for p in packed], pa.string())])


@query("op11_byte_bpe")
def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole text and what they decode to."""
    done = encode(read(spark, sf_dir, "documents").select("doc_id", "text"), load_model(), with_decoded=True)
    return done.select("doc_id", "n_tokens", F.sha2("tokens", 256).alias("ids_sha256"), F.sha2(F.col("decoded_text").cast("binary"), 256).alias("decoded_sha256"))
