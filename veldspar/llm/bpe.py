"""Byte-level BPE as a lazily determinised finite-state transducer, and streaming decoding.

Encoding. A vocabulary of byte strings with merge ranks defines one tokenisation per pre-token. Every prefix
of a pre-token has exactly one tokenisation, and a token sequence is the tokenisation of its bytes exactly
when each adjacent pair of tokens stays apart on its own. That makes the encoder a finite-state transducer:
a configuration is a node of the vocabulary's trie (the bytes read of a token not yet ended) with the tokens
chosen before it. The set of live configurations is one determinised state; the tokens that all of them
share are emitted. A configuration dies after at most the longest token's bytes, so lookahead is bounded.
A pre-token follows the transitions made so far; where one is missing, it runs on bare configurations, found by
the trie's automaton, or, every ``MAKE_EVERY``-th time, makes its transitions: so states are made where many
pre-tokens pass, and a long one (``LONG_WORD``) makes all of its own. All memories are bounded
(``MAX_STATES``, ``MAX_PAIRS``, ``MAX_WORDS``: some 90 MB together) and freed when a task ends.

Decoding. :class:`Utf8Stream` carries the incomplete bytes of a character from token to token through a
byte-wise UTF-8 automaton; its transitions by token are memoised too (at most one a token and state).
"""

from __future__ import annotations

import base64
import ctypes
import gc
from array import array
from itertools import chain, islice

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from veldspar.runtime import ensure_importable

#: Splits text before merges: contractions, letters, numbers, other marks, white space.
PATTERN = (
    r"'(?:s|t|re|ve|m|ll|d)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)
DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: States of the transducer, pairs judged and pre-tokens kept (twice, a younger and an older memory) at most.
MAX_STATES, MAX_PAIRS, MAX_WORDS = 20_000, 150_000, 120_000
#: Characters above which a text is encoded part by part; bytes above which a pre-token makes all its states.
LONG_TEXT, LONG_WORD = 1 << 20, 256
#: Of so many pre-tokens that miss a transition one makes its own.
MAKE_EVERY = 16
#: Rows whose tokens are held at once.
ROWS_AT_ONCE = 1000
NEVER = 1 << 60


class Encoder:
    """Byte-level BPE from merge ranks (``{token bytes: rank}``)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.ranks = ranks
        self.bytes = {i: b for b, i in ranks.items()}
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"no token for {len(missing)} single bytes")
        self.split_text = regex.compile(pattern)
        #: node * 256 + byte -> (node, token that ends there or -1, whether an edge leaves it)
        self.edges: dict[int, tuple[int, int, bool]] = {}
        trie: dict[int, int] = {}
        token_at: dict[int, int] = {}
        parents: set[int] = set()
        for token, rank in ranks.items():
            node = 0
            for b in token:
                parents.add(node)
                node = trie.setdefault(node << 8 | b, len(trie) + 1)
            token_at[node] = rank
        self.edges = {at: (node, token_at.get(node, -1), node in parents) for at, node in trie.items()}
        #: the trie with links to the longest shorter ending
        self.ending = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.ending.add_word(token.decode("latin-1"), (len(token), rank))
        self.ending.make_automaton()
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.forget()

    def forget(self) -> None:
        """Free all memories; the vocabulary's own tables stay."""
        self.missed = 0
        self.pairs: dict[int, bool] = {}
        self.spines: tuple[dict[int, list], dict[int, list]] = {}, {}
        self.words: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self._reset()

    def _reset(self) -> None:
        #: state * 256 + byte -> (state, tokens emitted); numbers alone, so forgetting them frees them at once
        self.moves: dict[int, tuple[int, tuple[int, ...]]] = {}
        self.numbers: dict[tuple, int] = {}
        self.states: list[tuple[int, tuple]] = []
        self.finals: list[tuple[int, ...]] = []
        self._state(-1, ((0, ()),))

    # --- which tokens may follow each other -----------------------------------------------------------

    def _spine(self, token: int, side: int) -> list[tuple[int, int, int]]:
        """(bytes, rank at which they appear, rank at which they are merged away), from the token down one side."""
        memory, whole = self.spines[side], token
        out = memory.get(whole)
        if out is None:
            out, death = [], NEVER
            while True:
                data = self.bytes[token]
                out.append((data, -1 if len(data) == 1 else token, death))
                if len(data) == 1:
                    break
                death, token = token, self._halves(token)[side]
            if len(memory) >= MAX_STATES:
                memory.clear()
            memory[whole] = out
        return out

    def _apart(self, left: int, right: int, below: int = NEVER) -> bool:
        """Whether merging never joins bytes across the boundary, seeing only merges of rank under ``below``."""
        ranks, tails = self.ranks.get, self._spine(right, 0)
        for head, born_a, dead_a in self._spine(left, 1):
            for tail, born_b, dead_b in tails:
                m = ranks(head + tail)
                if m is not None and m < below:
                    when = max(m, born_a, born_b)
                    if when < dead_a and when <= dead_b:
                        return False
        return True

    def _halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None if merging never makes it."""
        if token in self.halves:
            return self.halves[token]
        data, found = self.bytes[token], None
        for i in range(1, len(data)):
            a, b = self.ranks.get(data[:i]), self.ranks.get(data[i:])
            if a is None or b is None or (len(data) > 2 and max(a * (i > 1), b * (len(data) - i > 1)) >= token):
                continue
            if self._reachable(a) and self._reachable(b) and self._apart(a, b, token):
                found = a, b
                break
        self.halves[token] = found
        return found

    def _reachable(self, token: int) -> bool:
        return len(self.bytes[token]) == 1 or self._halves(token) is not None

    def _may_follow(self, left: int, right: int) -> bool:
        """Whether merging leaves ``right`` whole beside ``left`` (-1: at the beginning)."""
        if len(self.pairs) >= MAX_PAIRS:
            self.pairs.clear()
        known = self.pairs[left << 32 | right] = self._reachable(right) and (left < 0 or self._apart(left, right))
        return known

    # --- the transducer -------------------------------------------------------------------------------

    def _state(self, last: int, live: tuple) -> int:
        key = (last, live)
        number = self.numbers.get(key)
        if number is None:
            number = self.numbers[key] = len(self.states)
            self.states.append(key)
            self.finals.append(live[-1][1])
        return number

    def _step(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        last, before = self.states[state]
        edge, pairs = self.edges.get, self.pairs.get
        live, ended = [], None
        for node, chosen in before:
            after = edge(node << 8 | byte)
            if after is None:
                continue
            node, token, goes_on = after
            if token >= 0 and ended is None:
                left = chosen[-1] if chosen else last
                fits = pairs(left << 32 | token)
                if fits is None:
                    fits = self._may_follow(left, token)
                if fits:
                    ended = (*chosen, token)
            if goes_on:
                live.append((node, chosen))
        if live:
            sure, most = 0, min(len(ended), min(len(c) for _, c in live))
            while sure < most and all(c[sure] == ended[sure] for _, c in live):
                sure += 1
            if sure:
                live = [(node, c[sure:]) for node, c in live]
            live.append((0, ended[sure:]))
        else:
            sure = len(ended)
            live.append((0, ()))
        emitted = ended[:sure]
        if sure:
            last = emitted[-1]
        if len(self.states) > MAX_STATES:
            self._reset()
            return self._state(last, tuple(live)), emitted
        out = self.moves[state << 8 | byte] = self._state(last, tuple(live)), emitted
        return out

    def _whole(self, data: bytes) -> list[int]:
        """Tokens of one pre-token by its configurations, without making states.

        The automaton tells the tokens that end at each byte, longest first. The last token of a beginning is the first
        of these that may follow the last token of what precedes it; beginnings that no choice asks for are skipped.
        """
        ends: list[list] = [[] for _ in data]
        for end, found in self.ending.iter(data.decode("latin-1")):
            ends[end].append(found)
        known: list[int | None] = [-1, *[None] * len(data)]
        out, at = [], len(data)
        while at:
            token = known[at]
            if token is None:
                token = self._last(at, ends, known)
            out.append(token)
            at -= len(self.bytes[token])
        return out[::-1]

    def _last(self, at: int, ends: list[list], known: list[int | None]) -> int:
        """The last token of the first ``at`` bytes."""
        pairs = self.pairs.get
        for size, token in ends[at - 1]:
            left = known[at - size]
            if left is None:
                left = self._last(at - size, ends, known)
            fits = pairs(left << 32 | token)
            if self._may_follow(left, token) if fits is None else fits:
                break
        known[at] = token
        return token

    def encode_bytes(self, data: bytes) -> list[int]:
        """Tokens of one pre-token, in time linear in its length."""
        state, out, move, long = 0, [], self.moves.get, len(data) > LONG_WORD
        for k, b in enumerate(data):
            after = move(state << 8 | b)
            if after is None:
                if not long:
                    self.missed += 1
                    if self.missed % MAKE_EVERY:
                        return self._whole(data)
                after = self._step(state, b)
                move = self.moves.get
            state, emitted = after
            if emitted:
                out += emitted
        out += self.finals[state]
        return out

    def _word(self, word: str) -> tuple[int, ...]:
        """Tokens of a pre-token; the younger memory becomes the older one when full."""
        tokens = self.words.get(word) or self.older.get(word)
        if tokens is None:
            tokens = tuple(self.encode_bytes(word.encode()))
        if len(word) <= 64:
            if len(self.words) >= MAX_WORDS:
                self.older, self.words = self.words, {}
            self.words[word] = tokens
        return tokens

    def encode(self, text: str, out: array | None = None) -> array:
        """Token ids of a text, appended to ``out``."""
        out = array("i") if out is None else out
        if len(text) > LONG_TEXT:
            words = (m.group() for m in self.split_text.finditer(text))
            while some := list(islice(words, LONG_TEXT)):
                out.extend(self._encode_words(some))
        else:
            out.extend(self._encode_words(self.split_text.findall(text)))
        return out

    def _encode_words(self, words: list[str]) -> array:
        found = list(map(self.words.get, words))
        if None in found:
            make = self._word
            found = [make(w) if t is None else t for w, t in zip(words, found)]
        return array("i", chain.from_iterable(found))

    def decode(self, tokens) -> str:
        """Text of token ids; bytes that are not UTF-8 become U+FFFD."""
        stream = Utf8Stream(self.bytes)
        return stream.feed(tokens) + stream.end()


#: Automaton of UTF-8 by byte: state -> [(first byte, last byte, next state)]; 0 is between characters.
_UTF8 = {
    0: [(0x00, 0x7F, 0), (0xC2, 0xDF, 1), (0xE0, 0xE0, 4), (0xE1, 0xEC, 2), (0xED, 0xED, 5), (0xEE, 0xEF, 2),
        (0xF0, 0xF0, 6), (0xF1, 0xF3, 3), (0xF4, 0xF4, 7)],
    1: [(0x80, 0xBF, 0)],
    2: [(0x80, 0xBF, 1)],
    3: [(0x80, 0xBF, 2)],
    4: [(0xA0, 0xBF, 1)],
    5: [(0x80, 0x9F, 1)],
    6: [(0x90, 0xBF, 2)],
    7: [(0x80, 0x8F, 2)],
}
UTF8_NEXT = [[next((n for a, z, n in _UTF8[s] if a <= b <= z), -1) for b in range(256)] for s in range(8)]


class Utf8Stream:
    """Incremental decoder from tokens to text; the state between tokens is at most three bytes."""

    def __init__(self, token_bytes: dict[int, bytes]):
        self.token_bytes = token_bytes
        self.moves: dict[bytes, dict[int, tuple[str, bytes]]] = {b"": {}}
        #: what a token alone becomes that begins and ends between characters
        self.whole: dict[int, str] = {}
        self.pending = b""

    def _run(self, data: bytes) -> tuple[str, bytes]:
        """Complete characters of ``data``, and the bytes that may still become one."""
        state, begin, good, out = 0, 0, 0, []
        i = 0
        while i < len(data):
            after = UTF8_NEXT[state][data[i]]
            if after >= 0:
                state = after
                i += 1
                if not state:
                    begin = i
            else:  # the longest valid beginning becomes one replacement mark
                out.append(data[good:begin].decode() + "�")
                i = begin = good = i if i > begin else i + 1
                state = 0
        out.append(data[good:begin].decode())
        return "".join(out), data[begin:]

    def feed(self, tokens) -> str:
        """Text that is certain after ``tokens``."""
        if not self.pending:
            out = list(map(self.whole.get, tokens))
            if None not in out:
                return "".join(out)
            begin = out.index(None)
            out = out[:begin]
        else:
            begin, out = 0, []
        moves, pending = self.moves, self.pending
        row = moves[pending]
        for t in tokens[begin:] if begin else tokens:
            move = row.get(t)
            if move is None:
                move = row[t] = self._run(pending + self.token_bytes[t])
                moves.setdefault(move[1], {})
                if not pending and not move[1]:
                    self.whole[t] = move[0]
            text, after = move
            out.append(text)
            if after != pending:
                pending = after
                row = moves[pending]
        self.pending = pending
        return "".join(out)

    def end(self) -> str:
        """What is left at the end: a replacement mark if a character is incomplete."""
        left, self.pending = self.pending, b""
        return "�" if left else ""


_encoders: dict[str, tuple[Encoder, Utf8Stream]] = {}


def read_ranks(path: str) -> bytes:
    """The bytes of a rank file (lines of base64 token and rank), read on the driver and sent to the tasks."""
    with open(path, "rb") as f:
        return f.read()


def load_encoder(path: str, data: bytes | None = None) -> tuple[Encoder, Utf8Stream]:
    """The encoder and decoder of a rank file, or of its bytes; their tables are kept for the life of the process."""
    if path not in _encoders:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, (data or read_ranks(path)).splitlines())}
        encoder = Encoder(ranks)
        _encoders[path] = encoder, Utf8Stream(encoder.bytes)
    return _encoders[path]


def _give_back() -> None:
    """Return freed memory to the system, where the C library can, so that later stages in this worker have it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def _encode_batches(batches, path: str, ranks, keep: list[str], text_at: str, check: bool):
    encoder, stream = load_encoder(path, ranks.value)
    collecting = gc.isenabled()
    gc.disable()  # the memories hold no cycles, and looking for some among them takes longer than encoding
    try:
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS_AT_ONCE):
                yield _encode_rows(encoder, stream, batch.slice(k, ROWS_AT_ONCE), keep, text_at, check)
    finally:
        encoder.forget()
        if collecting:
            gc.enable()
        _give_back()


def _encode_rows(encoder: Encoder, stream: Utf8Stream, batch, keep: list[str], text_at: str, check: bool):
    flat, ends, exact, sizes = array("i"), [0], [], []
    null = np.zeros(batch.num_rows, dtype=bool)
    for k, text in enumerate(batch.column(text_at)):
        text = text.as_py()
        if text is None:
            null[k] = True
            exact.append(None)
            sizes.append(None)
        else:
            before = len(flat)
            encoder.encode(text, flat)
            sizes.append(len(flat) - before)
            exact.append(stream.feed(flat[before:]) + stream.end() == text if check else None)
        ends.append(len(flat))
    values = pa.array(np.frombuffer(flat, dtype=np.int32) if len(flat) else np.zeros(0, dtype=np.int32))
    tokens = pa.ListArray.from_arrays(pa.array(ends, type=pa.int32(), mask=np.append(null, False)), values)
    cols = [batch.column(c) for c in keep] + [pa.array(sizes, type=pa.int32()), tokens]
    names = [*keep, "n_tokens", "tokens"]
    if check:
        cols.append(pa.array(exact, type=pa.bool_()))
        names.append("exact")
    return pa.RecordBatch.from_arrays(cols, names=names)


def encode_column(
    docs: DataFrame,
    vocabulary: str = DEFAULT_VOCABULARY,
    text: str = "text",
    keep: list[str] | None = None,
    check: bool = True,
) -> DataFrame:
    """Add ``n_tokens``, ``tokens`` and (with ``check``) ``exact``: whether decoding gives the text back.

    ``keep`` names the columns carried along (default: all but the text and the added names). Null text gives
    null in all added columns; empty text gives no tokens and is exact; a text of any length is encoded whole.
    Columns of the input that are called like an added one are replaced. Rows are independent: there are no ties,
    repeated rows give repeated results, an empty table an empty one. No shuffle; one scan. The vocabulary is read
    on the driver and broadcast (its file's size, whatever the corpus).
    """
    added = {"n_tokens", "tokens", "exact"}
    keep = [c for c in (keep or docs.columns) if c not in added and c != text]
    spark = docs.sparkSession
    ensure_importable(spark)
    ranks = spark.sparkContext.broadcast(read_ranks(vocabulary))
    fields = [docs.schema[c] for c in keep] + [
        T.StructField("n_tokens", T.IntegerType()),
        T.StructField("tokens", T.ArrayType(T.IntegerType())),
    ]
    if check:
        fields.append(T.StructField("exact", T.BooleanType()))

    def run(batches):
        return _encode_batches(batches, vocabulary, ranks, keep, text, check)

    return docs.select(*keep, text).mapInArrow(run, T.StructType(fields))


def decode_column(df: DataFrame, vocabulary: str = DEFAULT_VOCABULARY, tokens: str = "tokens") -> DataFrame:
    """Add ``decoded``: the text of the token ids.

    Null ids give null, no ids an empty text, unknown ids an error. Bytes that are not UTF-8 become U+FFFD. Rows
    are independent; an empty table gives an empty one; a column called ``decoded`` is replaced.
    """
    spark = df.sparkSession
    ensure_importable(spark)
    ranks = spark.sparkContext.broadcast(read_ranks(vocabulary))
    keep = [c for c in df.columns if c != "decoded"]
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField("decoded", T.StringType())])

    def run(batches):
        _, stream = load_encoder(vocabulary, ranks.value)
        for batch in batches:
            ids = batch.column(tokens)
            out = [None if x is None else stream.feed(x) + stream.end() for x in ids.to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in keep] + [pa.array(out, type=pa.string())], names=[*keep, "decoded"]
            )

    return df.select(*keep).mapInArrow(run, schema)
