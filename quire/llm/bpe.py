"""Byte-level BPE encoding and decoding.

Encoding. Merges are compiled into a transducer that reads one byte at a time.
For every prefix of a piece BPE leaves exactly one last token: the token t that
ends there and whose neighbour, the last token of the prefix before t, stays
apart from it when the two are merged on their own. So the machine need not know
the future to know each prefix; it only does not know yet which prefix the
piece's tokens will end on. Its state holds, for each position where a token
could still begin (the bytes since then begin some token of the vocabulary), the
tokens up to there that have not been emitted. Tokens that all these positions
share can no longer change and are emitted; a token can be delayed by no more
bytes than the longest token has. States are made when first reached and kept
with their transitions, so a byte seen in a known state costs one look-up.

Decoding. Ids are looked up as bytes; text comes from an incremental UTF-8 state
machine that holds back the bytes of an unfinished character, so a stream may be
cut anywhere.

The rank file's path is a parameter. Pieces are the matches of the vocabulary's
split pattern, each encoded separately; there are no special tokens. A piece that
is itself a token is that token.

Defined results: null text is empty and has no ids; repeated rows are encoded
alike; a text of any length is taken piece by piece; other columns are neither
read nor returned; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import SPACE, column_bytes, slices, small_batches, taken, text_of, worker_store

# stores are dropped whole beyond these sizes and filled anew: memory stays bounded, results do not change
KEPT_STATES = 400_000
KEPT_PIECES = 300_000
KEPT_WORDS = 500_000
SLICE = 4 << 20  # bytes of text whose words are looked up together


def read_ranks(lines: Iterable[bytes]) -> dict[bytes, int]:
    """Tokens and ranks of a rank file: base64 and a number on each line."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class Utf8Machine:
    """Incremental UTF-8 decoder: ``feed`` gives the text that is complete, ``end`` what is left over.

    State is how many bytes are still due and which values the next one may have.
    Bytes that cannot be part of any character become U+FFFD, one for each
    longest run that began a character.
    """

    def __init__(self):
        self.due, self.low, self.high, self.held = 0, 0x80, 0xBF, bytearray()

    def feed(self, data: bytes) -> str:
        if not self.due:
            try:  # whole characters, the usual case
                return data.decode()
            except UnicodeDecodeError:
                pass
        out = []
        for b in data:
            if self.due:
                if self.low <= b <= self.high:
                    self.held.append(b)
                    self.due, self.low, self.high = self.due - 1, 0x80, 0xBF
                    if not self.due:
                        out.append(self.held.decode())
                        self.held.clear()
                    continue
                out.append("�")
                self.held.clear()
                self.due, self.low, self.high = 0, 0x80, 0xBF
            if b < 0x80:
                out.append(chr(b))
            elif 0xC2 <= b <= 0xF4:
                self.due = 1 if b < 0xE0 else 2 if b < 0xF0 else 3
                self.low = {0xE0: 0xA0, 0xF0: 0x90}.get(b, 0x80)
                self.high = {0xED: 0x9F, 0xF4: 0x8F}.get(b, 0xBF)
                self.held.append(b)
            else:
                out.append("�")
        return "".join(out)

    def end(self) -> str:
        left = "�" if self.due else ""
        self.__init__()
        return left


class Transducer:
    """The merges as a lazily determinised machine from bytes to token ids."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self.begins = {t[:k] for t in ranks for k in range(1, len(t) + 1)}
        self.apart: dict[tuple[int, int], bool] = {}
        self.single = [bytes((b,)) for b in range(256)]
        #: how each token was merged (a single byte: no entry), and the merge of two tokens
        self.halves: dict[int, tuple[int, int]] = {}
        self.merges: dict[tuple[int, int], int] = {}
        for token, i in ranks.items():
            if len(token) > 1:
                parts = self.merged(token, i)
                if len(parts) == 2:
                    self.halves[i] = parts[0], parts[1]
                    self.merges[parts[0], parts[1]] = i
        self._reset()

    def _reset(self):
        #: a state is its moves: byte -> (next state, ids that are certain then); under -1 what it stands for
        self.states: dict[tuple, dict] = {}
        self.start = self._state((-1, ((b"", ()),)))

    def _state(self, key: tuple) -> dict:
        at = self.states.get(key)
        if at is None:
            at = self.states[key] = {-1: key}
        return at

    def merged(self, data: bytes, below: int = 1 << 60) -> list[int]:
        """The tokens of a short byte string by the merges of rank under ``below``: lowest first, leftmost of equals."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, i = min((self.ranks.get(parts[i] + parts[i + 1], below), i) for i in range(len(parts) - 1))
            if best >= below:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def _stay_apart(self, a: int, b: int) -> bool:
        """Whether no merge ever joins bytes of ``a`` and ``b`` when they stand side by side.

        Undo the later of the two sides' last merges again and again; at every
        time in between the two facing halves must not have had a merge that came
        before the undone one.
        """
        known = self.apart.get((a, b))
        if known is not None:
            return known
        left, right, until = a, b, 1 << 60
        while True:
            joined = self.merges.get((left, right))
            if joined is not None and joined < until:
                apart = False
                break
            # which side was merged last before `until`; equal ranks merge from the left
            l_half, r_half = self.halves.get(left), self.halves.get(right)
            if l_half is None and r_half is None:
                apart = True
                break
            if r_half is None or (l_half is not None and left > right):
                until, left = left, l_half[1]
            else:
                until, right = right + 1, r_half[0]
        self.apart[a, b] = apart
        return apart

    def _move(self, state: dict, byte: int) -> tuple[dict, tuple[int, ...]]:
        """The next state, and the ids that are certain now.

        A state stands for (last id emitted, ((bytes since a position, ids up to it), ...)),
        positions from the oldest to the end of what was read.
        """
        last, open_ = state[-1]
        ranks, begins, one = self.ranks, self.begins, self.single[byte]
        live, here = [], None
        for since, ids in open_:
            since += one
            if here is None:  # the longest token first
                token = ranks.get(since)
                if token is not None:
                    before = ids[-1] if ids else last
                    if before < 0 or self._stay_apart(before, token):
                        here = ids + (token,)
            if since in begins:
                live.append((since, ids))
        if here is None:
            raise ValueError("the ranks do not hold every single byte")
        live.append((b"", here))
        shared = 0
        first = live[0][1]
        if first:
            while shared < len(first) and all(len(ids) > shared and ids[shared] == first[shared] for _, ids in live):
                shared += 1
        sure = first[:shared]
        if shared:
            last = sure[-1]
            live = [(since, ids[shared:]) for since, ids in live]
        if all([ids for _, ids in live]):
            last = -1  # no position can ask for it any more, so states meet
        made = state[byte] = self._state((last, tuple(live))), sure
        return made

    def ids(self, piece: bytes) -> list[int]:
        """The token ids of one piece."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(self.states) > KEPT_STATES:
            self._reset()
        state, out = self.start, []
        for byte in piece:
            try:
                state, sure = state[byte]
            except KeyError:
                state, sure = self._move(state, byte)
            if sure:
                out += sure
        out += state[-1][1][-1][1]
        return out


#: white space beyond ASCII, and what else counts as such by other patterns
_WIDE = [bytes(c, "utf-8") for c in map(chr, (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))]
_WHITE = SPACE.copy()
_WHITE[0x1C:0x20] = True


def _white(data: np.ndarray) -> np.ndarray:
    """Which bytes belong to white space."""
    white = _WHITE[data]
    for lead in {c[0] for c in _WIDE}:
        at = np.flatnonzero(data == lead)
        for c in _WIDE if len(at) else ():
            if c[0] == lead:
                here = at[at + len(c) <= len(data)]
                for k in range(1, len(c)):
                    here = here[data[here + k] == c[k]]
                for k in range(len(c)):
                    white[here + k] = True
    return white


class Codec:
    """Encoding of whole texts, with a store of words met before; decoding of id streams.

    A space between two other characters that are not white space begins a piece
    under the pattern, whatever stands around it. So texts are cut before each such
    space, and what lies between is looked up as a whole, each distinct word of a
    few megabytes once; only words not met before are matched against the pattern
    and run through the machine.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.machine = Transducer(ranks)
        self.split = regex.compile(pattern).findall
        # ASCII letters after a space or none; one match unless the pattern says otherwise
        self.simple = all(self.split(w) == [w] for w in ("azAZ", " azAZ"))
        self.decimals = {i: b" %d" % i for i in self.machine.tokens}
        self.table = pa.array([self.machine.tokens.get(i) for i in range(max(self.machine.tokens) + 1)], pa.large_binary())
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.words: dict[bytes, tuple[bytes, bytes]] = {}

    def _learn(self, word: bytes) -> tuple[bytes, bytes]:
        """Ids of a word, and the same as decimals, by the pattern and the machine."""
        if self.simple and word.lstrip(b" ").isalpha() and not word.startswith(b"  "):
            ids = self.machine.ids(word)
        else:
            ids, known = [], self.pieces
            for piece in self.split(word.decode()):
                got = known.get(piece)
                if got is None:
                    got = tuple(self.machine.ids(piece.encode()))
                    if len(piece) <= 32:
                        if len(known) >= KEPT_PIECES:
                            known.clear()
                        known[piece] = got
                ids += got
        made = array("I", ids).tobytes(), b"".join(map(self.decimals.__getitem__, ids))
        if len(word) <= 32:
            if len(self.words) >= KEPT_WORDS:
                self.words.clear()
            self.words[word] = made
        return made

    def encode_texts(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, memoryview, np.ndarray]:
        """Ids of texts side by side and where each text's begin; the same as decimals, each after a space."""
        space = np.flatnonzero(data == 0x20)
        space = space[(space > 0) & ~np.isin(space + 1, at)]
        white = _white(data)
        begin = np.zeros(len(data) + 1, bool)
        begin[space[~white[space - 1] & ~white[space + 1]]] = True
        begin[at] = True
        begin[-1] = True
        cut = np.flatnonzero(begin) if len(data) else np.zeros(1, np.int64)
        parts = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(cut) - 1, [None, pa.py_buffer(cut), pa.py_buffer(np.ascontiguousarray(data))]
        ).dictionary_encode()
        words = parts.dictionary.to_pylist()
        found = list(map(self.words.get, words))
        found = [self._learn(w) if f is None else f for w, f in zip(words, found, strict=True)]
        first = np.searchsorted(cut, at)
        ids, n = taken([f[0] for f in found], parts.indices)
        decimals, m = taken([f[1] for f in found], parts.indices)
        return np.frombuffer(ids, np.uint32)[: n[-1] // 4], n[first] // 4, decimals, m[first]

    def encode(self, text: str) -> list[int]:
        data = np.frombuffer(text.encode(), np.uint8)
        return self.encode_texts(data, np.array([0, len(data)]))[0].tolist()

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.machine.tokens.__getitem__, ids))

    def decode_ids(self, ids: np.ndarray) -> tuple[memoryview, np.ndarray]:
        """The bytes of ids one after the other, and where each begins and the last ends."""
        return taken(self.table, pa.array(ids))

    def decode_stream(self, ids: Iterable[int]) -> Iterator[str]:
        """Text as it becomes complete, id by id."""
        utf8 = Utf8Machine()
        for i in ids:
            done = utf8.feed(self.machine.tokens[i])
            if done:
                yield done
        rest = utf8.end()
        if rest:
            yield rest


def codec_of(name: str, pattern: str) -> Codec:
    """The codec of a rank file that ``SparkContext.addFile`` has sent, one for each worker process."""
    kept = worker_store()
    if (name, pattern) not in kept:
        with open(SparkFiles.get(name), "rb") as lines:
            kept[name, pattern] = Codec(read_ranks(lines), pattern)
    return kept[name, pattern]


def send_file(df: DataFrame, path: str) -> str:
    """Give every executor the vocabulary file; the name under which it finds it."""
    df.sparkSession.sparkContext.addFile(path)
    return path.rsplit("/", 1)[-1]


def encode_documents(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) for every row."""
    small_batches(docs)
    name = send_file(docs, path)

    def run(batches):
        codec = codec_of(name, pattern)
        for batch in batches:
            ids = [codec.encode(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "ids": pa.array(ids, pa.list_(pa.int32()))})

    return text_of(docs, key, text).mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids), each list of ids read as a stream."""
    name = send_file(encoded, path)

    def run(batches):
        codec = codec_of(name, pattern)
        for batch in batches:
            texts = ["".join(codec.decode_stream(ids or ())) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "text": pa.array(texts, pa.string())})

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of encoding each text and decoding its ids again."""
    small_batches(docs)
    name = send_file(docs, path)

    def run(batches):
        codec = codec_of(name, pattern)
        gc.disable()  # the stores hold millions of small tuples and no cycles
        for batch in batches:
            counts, id_sums, text_sums = [], [], []
            data, at = column_bytes(batch.column(1))
            for i, j in slices(at, SLICE):
                ids, first, decimals, written = codec.encode_texts(data[at[i] : at[j]], at[i : j + 1] - at[i])
                decoded, ends = codec.decode_ids(ids)
                counts += np.diff(first).tolist()
                written = written.tolist()
                id_sums += [hashlib.sha256(decimals[a + 1 : b]).hexdigest() for a, b in zip(written, written[1:], strict=False)]
                ends = ends[first].tolist()
                text_sums += [hashlib.sha256(decoded[a:b]).hexdigest() for a, b in zip(ends, ends[1:], strict=False)]
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column(0),
                    "n_tokens": pa.array(counts, pa.int64()),
                    "ids_sha256": pa.array(id_sums, pa.string()),
                    "decoded_sha256": pa.array(text_sums, pa.string()),
                }
            )

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return text_of(docs, key, text).select(F.col("doc_id"), F.col("text")).mapInArrow(run, schema)
