"""Byte-level BPE encoding by a lazily determinised transducer, and streaming decoding.

Encoding.  A token sequence is the BPE encoding of its bytes exactly when every two neighbours are the
encoding of their own concatenation.  So the encoding of a prefix is its last token after the encoding of
a shorter prefix, and only starts from which some token can still grow matter for what follows.  A state is
that set of live starts with their token paths since the last token they all share; reading a byte extends
it, and every token common to all live paths is emitted: the lookahead is bounded by the longest token.
The last emitted token is a register beside the state; where a token could start right after it, the
transition asks whether the two may be neighbours.
States and transitions are made on first use and interned; when there are ``MAX_STATES`` the automaton is
emptied and grows anew, which bounds memory and changes no result.

Decoding.  Token bytes run through a UTF-8 state machine that holds back only an unfinished sequence at the
end of a chunk, so pieces of text come out while ids still arrive.

Defined results: a null text is empty and has no ids; texts of any length are encoded whole (one match of
the pattern at a time); repeated rows give repeated results; other columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_STATES = 150_000
#: Encoded matches remembered per worker.
MAX_MEMO = 400_000
#: Added to a byte in the transition table: the token in question may or may not follow the last one.
FITS, CLASHES = 256, 512
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Transducer:
    """Encoder of single pattern matches for one rank table."""

    def __init__(self, ranks: dict[bytes, int], max_states: int = MAX_STATES):
        self.ranks, self.max_states = ranks, max_states
        self.bytes_of = {i: t for t, i in ranks.items()}
        # Tokens that merging can reach, and the two parts of their last merge (single bytes have none).
        # Any other token is the encoding of a match only as the whole match.
        self.reached: dict[bytes, int] = {}
        self.parts: dict[int, tuple[int, int] | None] = {}
        for t, i in ranks.items():
            halves = self._merge(t, 2)
            if len(t) == 1 or len(halves) == 2 and self._merge(t) == [i]:
                self.reached[t] = i
                self.parts[i] = tuple(halves) if len(t) > 1 else None
        self.grows = {t[:k] for t in self.reached for k in range(1, len(t))}       # proper prefixes of tokens
        self._pairs: dict[tuple[int, int], bool] = {}
        self.resets = 0
        self._reset()

    def _merge(self, piece: bytes, until: int = 1) -> list[int]:
        """Merging by rank, leftmost first, down to ``until`` parts: used on vocabulary entries only."""
        ranks, parts = self.ranks, [piece[i:i + 1] for i in range(len(piece))]
        while len(parts) > until:
            best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], 1 << 60))
            joined = parts[best] + parts[best + 1]
            if joined not in ranks:
                break
            parts[best:best + 2] = [joined]
        return [ranks[p] for p in parts]

    def _fits(self, left: int, right: int) -> bool:
        """Whether merging leaves the border between two tokens alone.

        Both tokens are undone merge by merge, the latest first; the border breaks if the parts that touch
        it at some time could merge before the next merge that happened in either token."""
        key = (left, right)
        known = self._pairs.get(key)
        if known is None:
            if len(self._pairs) > 4 * self.max_states:
                self._pairs.clear()
            known = self._pairs[key] = self._border_holds(left, right)
        return known

    def _border_holds(self, left: int, right: int) -> bool:
        ranks, bytes_of, parts = self.ranks, self.bytes_of, self.parts
        limit = 1 << 60                                 # rank of the merge undone last
        tie = False                                     # whether that merge lies to the right of the border
        while True:
            joined = ranks.get(bytes_of[left] + bytes_of[right])
            if joined is not None and (joined < limit or joined == limit and tie):
                return False
            a, b = parts[left], parts[right]
            if a is None and b is None:
                return True
            if b is None or a is not None and left > right:
                limit, left, tie = left, a[1], False
            else:
                limit, right, tie = right, b[0], True

    def _reset(self) -> None:
        self._ids: dict[tuple, int] = {}
        self._states: list[tuple] = []
        #: For each state: byte -> move, or byte -> token whose fit to the last emitted token decides between
        #: the moves under byte + FITS and byte + CLASHES.
        self.delta: list[dict[int, tuple[int, tuple[int, ...]] | int]] = []
        self.final: list[tuple[int, ...]] = []
        self._intern((b"", ((0, ()),)))

    def _intern(self, state: tuple) -> int:
        known = self._ids.get(state)
        if known is None:
            known = self._ids[state] = len(self._states)
            self._states.append(state)
            self.delta.append({})
            self.final.append(state[1][-1][1])
        return known

    def _move(self, s: int, byte: int, last: int) -> tuple[int, tuple[int, ...]]:
        """The transition of state ``s`` on ``byte`` after the emitted token ``last``: made when first needed."""
        moves = self.delta[s]
        move = moves.get(byte)
        if move is None:
            tail, live = self._states[s]
            token = None if live[0][1] else self.reached.get(tail + bytes((byte,)))
            move = moves[byte] = self._step(s, byte, True) if token is None else token
        if move.__class__ is int:
            fits = last < 0 or self._fits(last, move)
            key = byte + (FITS if fits else CLASHES)
            move = moves.get(key)
            if move is None:
                move = moves[key] = self._step(s, byte, fits)
        return move

    def _step(self, s: int, byte: int, fits: bool) -> tuple[int, tuple[int, ...]]:
        """The next state and the tokens that are certain now.  A path is empty only where the last emitted
        token ends; ``fits`` tells whether a token from there may follow that one."""
        tail, live = self._states[s]
        tail += bytes((byte,))
        found, alive = None, []
        for start, path in live:
            grown = tail[start:]
            if found is None:
                token = self.reached.get(grown)
                if token is not None and (self._fits(path[-1], token) if path else fits):
                    found = path + (token,)
            if grown in self.grows:
                alive.append((start, path))
        alive.append((len(tail), found))
        shared = 0
        for tokens in zip(*(p for _, p in alive)):
            if tokens.count(tokens[0]) < len(tokens):
                break
            shared += 1
        first = alive[0][0]
        if shared or first:
            tail, alive = tail[first:], [(start - first, path[shared:]) for start, path in alive]
        return self._intern((tail, tuple(alive))), found[:shared]

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(self._states) > self.max_states:
            self.resets += 1
            self._reset()
        if len(piece) > self.max_states:
            return list(self.stream(piece))
        s, last, delta, ids, fits = 0, -1, self.delta, [], self._pairs
        for byte in piece:
            moves = delta[s]
            move = moves.get(byte)
            if move.__class__ is int:                  # most often the pair and the move are known
                known = last < 0 or fits.get((last, move))
                move = None if known is None else moves.get(byte + (FITS if known else CLASHES))
            s, sure = move or self._move(s, byte, last)
            if sure:
                ids += sure
                last = sure[-1]
        ids += self.final[s]
        return ids

    def stream(self, piece: Iterable[int]) -> Iterator[int]:
        """Ids of one match while its bytes arrive."""
        s, last = 0, -1
        for byte in piece:
            if len(self._states) > 2 * self.max_states:              # keep this state only
                state, self.resets = self._states[s], self.resets + 1
                self._reset()
                s = self._intern(state)
            s, sure = self._move(s, byte, last)
            if sure:
                yield from sure
                last = sure[-1]
        yield from self.final[s]


#: Length of a UTF-8 sequence by its first byte (0: not a first byte), from the byte ranges of the standard.
_SEQUENCE = bytes(1 if b < 0x80 else 0 if b < 0xC2 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4 if b < 0xF5 else 0
                  for b in range(256))


class Utf8Machine:
    """Bytes in, text out; an unfinished sequence waits for the next chunk.  Invalid bytes become U+FFFD."""

    def __init__(self):
        self.held = b""

    def feed(self, chunk: bytes, last: bool = False) -> str:
        data = self.held + chunk
        cut = len(data)
        if not last:
            for back in range(1, min(3, len(data)) + 1):
                need = _SEQUENCE[data[-back]]
                if need:
                    if need > back:
                        cut -= back
                    break
                if not 0x80 <= data[-back] < 0xC0:
                    break
        self.held = data[cut:]
        return data[:cut].decode("utf-8", "replace")


def decode_stream(ids: Iterable[int], bytes_of: dict[int, bytes], chunk: int = 4096) -> Iterator[str]:
    """Text of an id stream, piece by piece."""
    machine, held = Utf8Machine(), []
    for i in ids:
        held.append(bytes_of[i])
        if len(held) == chunk:
            yield machine.feed(b"".join(held))
            held.clear()
    yield machine.feed(b"".join(held), last=True)


class Codec:
    """Whole texts: pattern matches through the transducer, with a bounded memo of matches."""

    def __init__(self, path: str, pattern: str, max_states: int = MAX_STATES, max_memo: int = MAX_MEMO):
        import regex

        self.transducer = Transducer(load_ranks(path), max_states)
        self.bytes_of, self.max_memo = self.transducer.bytes_of, max_memo
        self._matches = regex.compile(pattern)
        self._memo: dict[str, tuple[int, ...]] = {}

    def encode(self, text: str | None) -> list[int]:
        ids, memo, encode = [], self._memo, self.transducer.encode
        add = ids.extend
        for piece in self._matches.findall(text or ""):
            known = memo.get(piece)
            if known is None:
                if len(memo) >= self.max_memo:
                    memo.clear()
                known = tuple(encode(piece.encode("utf-8", "replace")))
                if len(piece) <= 64:
                    memo[piece] = known
            add(known)
        return ids


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One codec for each worker process and vocabulary."""
    key = (path, pattern)
    if key not in _CODECS:
        _CODECS[key] = Codec(path, pattern)
    return _CODECS[key]


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_documents(docs: DataFrame, vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, ids (array<int>) and the text decoded from the ids."""
    def run(batches):
        import public_tokenizers

        own = codec(vocabulary or vocabulary_path(), pattern or public_tokenizers.PATTERN)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = own.encode(text)
                back = "".join(decode_stream(ids, own.bytes_of))
                yield pa.RecordBatch.from_arrays([pa.array([doc_id], pa.int64()), pa.array([ids], pa.list_(pa.int32())),
                                                  pa.array([back])], ["doc_id", "ids", "decoded"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digest_documents(docs: DataFrame, vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: digests taken next to the encoder, ids never leave the worker."""
    def run(batches):
        import public_tokenizers

        own = codec(vocabulary or vocabulary_path(), pattern or public_tokenizers.PATTERN)
        for batch in batches:
            counts, encoded, decoded = [], [], []
            for text in batch.column(1).to_pylist():
                ids = own.encode(text)
                counts.append(len(ids))
                encoded.append(hashlib.sha256(str(ids)[1:-1].replace(" ", "").encode()).hexdigest())
                digest = hashlib.sha256()
                for piece in decode_stream(ids, own.bytes_of):
                    digest.update(piece.encode())
                decoded.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(encoded, pa.string()),
                                              pa.array(decoded, pa.string())],
                                             ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op8_bpe_transducer(spark, sf_dir: str) -> DataFrame:
    return digest_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
