"""Byte-level BPE as a lazily determinised finite-state transducer, and its streaming decoder.

The merges define which adjacent tokens may stand beside each other; a token sequence is the
encoding of its bytes exactly when every token encodes itself and every adjacent pair encodes to
that pair. The non-deterministic machine therefore has one thread per place where a token may have
begun: (trie node of the bytes since then, last token before). Reading a byte moves every thread in
the vocabulary trie; a thread that completes a token which may follow its last one starts a new
thread at the root. At each place exactly one token can end the encoding of the bytes so far, so the
set of threads, no more than the longest token has bytes, is the whole state, and a transition hands
out that token as a candidate. The sets met are numbered and their transitions remembered
(determinisation on demand). Candidates on which all live threads agree are emitted every LOOKAHEAD
bytes and at the end, so a pre-token of any length takes bounded memory.

Decoding is a machine too: a state holds the bytes of an unfinished UTF-8 character, and a token moves
it, handing out the bytes of finished characters.
"""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import kept, map_arrow, table


def read_ranks(data: bytes) -> dict[bytes, int]:
    """A rank file: base64 of the token's bytes, a space, the id, on each line."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


#: Bytes read between emissions.
LOOKAHEAD = 256
#: Pairs of tokens remembered: what they merge to, and whether one may follow the other.
MAX_PAIRS = 1 << 17


class Transducer:
    """encode(bytes) gives the ids of one pre-token, stream(chunks) those of a long one as they are settled.

    max_states bounds the remembered states; on reaching it they are forgotten and built anew.
    """

    def __init__(self, ranks: dict[bytes, int], max_states: int = 200_000):
        self.ranks, self.max_states = ranks, max_states
        self.bytes_of = {t: b for b, t in ranks.items()}
        self.length = {t: len(b) for b, t in ranks.items()}
        self.child: dict[int, int] = {}
        self.token_at: dict[int, int] = {}
        self.depth = [0]
        for b, t in ranks.items():
            node = 0
            for x in b:
                key = node << 8 | x
                nxt = self.child.get(key)
                if nxt is None:
                    nxt = self.child[key] = len(self.depth)
                    self.depth.append(self.depth[node] + 1)
                node = nxt
            self.token_at[node] = t
        # A thread is its node and its last token's id plus 1 (0: none) in one integer, as a transition is state and token.
        self.bits = (max(ranks.values()) + 1).bit_length()
        self.mask = (1 << self.bits) - 1
        #: By node: the id plus 1 of the token that ends there (0: none), and whether longer ones begin with its bytes.
        self.token_of = [self.token_at.get(node, -1) + 1 for node in range(len(self.depth))]
        self.inner = bytearray(len(self.depth))
        for key in self.child:
            self.inner[key >> 8] = 1
        self.spines: dict[int, tuple | None] = {}
        self.joined: dict[int, int] = {}
        self.follows: dict[int, bool] = {}
        self.forget()

    def forget(self) -> None:
        self.states: dict[tuple, int] = {}
        self.threads: list[tuple] = []
        self.moves: dict[int, int] = {}
        self.begin = self.number((0,))

    def number(self, threads: tuple) -> int:
        n = self.states.get(threads)
        if n is None:
            n = self.states[threads] = len(self.threads)
            self.threads.append(threads)
        return n

    def merged(self, data: bytes, below: float = float("inf")) -> list[int]:
        """Encoding by definition: merge the adjacent pair of lowest rank until none (of a rank below the limit) is left."""
        parts = [bytes([x]) for x in data]
        while len(parts) > 1:
            best, at = below, -1
            for i in range(len(parts) - 1):
                r = self.ranks.get(parts[i] + parts[i + 1])
                if r is not None and r < best:
                    best, at = r, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def spine(self, token: int) -> tuple[tuple, tuple] | None:
        """The tokens at the left and at the right edge of a token while it is merged, the smallest
        first; None if its bytes are not encoded as this token."""
        if token not in self.spines:
            data = self.bytes_of[token]
            if len(data) == 1:
                self.spines[token] = (token,), (token,)
            else:
                halves = self.merged(data, token)
                parts = [self.spine(h) for h in halves]
                whole = len(halves) == 2 and None not in parts and self.merged(data) == [token]
                self.spines[token] = ((*parts[0][0], token), (*parts[1][1], token)) if whole else None
        return self.spines[token]

    def compatible(self, a: int, b: int) -> bool:
        """Whether b may follow a (-1: the beginning): whether no merge takes place across their border.

        Both sides are merged as if alone, in the order of ranks, with a look at each step whether
        the two tokens at the border would be merged first; of equal ranks the left one goes first.
        """
        right = self.spine(b)
        if right is None or a < 0:
            return right is not None
        xs, ys, i, j = self.spine(a)[1], right[0], 0, 0
        x, y, last_x, last_y = xs[0], ys[0], len(xs) - 1, len(ys) - 1
        while True:
            key = x << self.bits | y
            m = self.joined.get(key)
            if m is None:
                if len(self.joined) > MAX_PAIRS:
                    self.joined.clear()
                m = self.joined[key] = self.ranks.get(self.bytes_of[x] + self.bytes_of[y], self.mask)
            next_x = xs[i + 1] if i < last_x else self.mask
            next_y = ys[j + 1] if j < last_y else self.mask
            if m < next_x and m <= next_y and m != self.mask:
                return False
            if i == last_x and j == last_y:
                return True
            if next_x <= next_y:
                i, x = i + 1, next_x
            else:
                j, y = j + 1, next_y

    def may_follow(self, last: int, token: int) -> bool:
        """compatible() of ids plus 1 (last is 0 at the beginning), remembered."""
        key = last << self.bits | token
        known = self.follows.get(key)
        if known is None:
            if len(self.follows) > MAX_PAIRS:
                self.follows.clear()
            known = self.follows[key] = self.compatible(last - 1, token - 1)
        return known

    def step(self, state: int, byte: int) -> int:
        """The move out of a state: next state and the token that ends here (its id plus 1).

        A thread whose bytes no longer token begins with moves no further and is left out.
        """
        live, ended = [], 0
        child, bits, mask, inner = self.child, self.bits, self.mask, self.inner
        for thread in self.threads[state]:
            nxt = child.get(thread >> bits << 8 | byte)
            if nxt is not None:
                last = thread & mask
                if inner[nxt]:
                    live.append(nxt << bits | last)
                if not ended:
                    token = self.token_of[nxt]
                    if token and self.may_follow(last, token):
                        ended = token
        live.append(ended)
        move = self.moves[state << 8 | byte] = self.number(tuple(live)) << bits | ended
        return move

    def back(self, ends: list[int], at: int) -> list[int]:
        """The tokens that lead to a place, of the candidates at each."""
        out = []
        while at > 0:
            token = ends[at - 1] - 1
            out.append(token)
            at -= self.length[token]
        out.reverse()
        return out

    def settled(self, ends: list[int], state: int) -> list[int]:
        """The first tokens on which all live threads agree."""
        paths = [self.back(ends, len(ends) - self.depth[t >> self.bits]) for t in self.threads[state]]
        agreed = 0
        while all(len(p) > agreed and p[agreed] == paths[0][agreed] for p in paths):
            agreed += 1
        return paths[0][:agreed]

    def stream(self, chunks):
        """Tokens of one pre-token given in chunks of bytes, in lists, each as soon as it is settled."""
        if len(self.threads) > self.max_states:
            self.forget()
        ends: list[int] = []
        state, bits, mask, get, add = self.begin, self.bits, self.mask, self.moves.get, ends.append
        for chunk in chunks:
            for at in range(0, len(chunk), LOOKAHEAD):
                for x in chunk[at : at + LOOKAHEAD]:
                    move = get(state << 8 | x)
                    if move is None:
                        move = self.step(state, x)
                    state = move >> bits
                    add(move & mask)
                if len(ends) > LOOKAHEAD:
                    tokens = self.settled(ends, state)
                    yield tokens
                    del ends[: sum(map(self.length.__getitem__, tokens))]
                    if len(self.threads) > self.max_states:
                        threads = self.threads[state]
                        self.forget()
                        state, get = self.number(threads), self.moves.get
        yield self.back(ends, len(ends))

    def encode(self, data: bytes) -> list[int]:
        if len(data) <= LOOKAHEAD:  # nothing is settled before the end
            if len(self.threads) > self.max_states:
                self.forget()
            state, bits, mask, get, ends = self.begin, self.bits, self.mask, self.moves.get, []
            for x in data:
                move = get(state << 8 | x) or self.step(state, x)
                state = move >> bits
                ends.append(move & mask)
            return self.back(ends, len(ends))
        parts = [*self.stream((data,))]
        return parts[0] if len(parts) == 1 else [t for p in parts for t in p]


#: UTF-8 by state: bytes still due and the range the next one must lie in.
_START = 0
_RANGES = {
    0: [(0x00, 0x7F, 0), (0xC2, 0xDF, 1), (0xE0, 0xE0, 4), (0xE1, 0xEC, 2), (0xED, 0xED, 5), (0xEE, 0xEF, 2), (0xF0, 0xF0, 6), (0xF1, 0xF3, 3), (0xF4, 0xF4, 7)],
    1: [(0x80, 0xBF, 0)],
    2: [(0x80, 0xBF, 1)],
    3: [(0x80, 0xBF, 2)],
    4: [(0xA0, 0xBF, 1)],
    5: [(0x80, 0x9F, 1)],
    6: [(0x90, 0xBF, 2)],
    7: [(0x80, 0x8F, 2)],
}
_MOVE = {(s, b): n for s, ranges in _RANGES.items() for lo, hi, n in ranges for b in range(lo, hi + 1)}


class _Held(dict):
    """A state of the decoder: the bytes of an unfinished character. Maps a token to (next state, bytes handed out)."""

    __slots__ = ("decoder", "held")

    def __missing__(self, token: int):
        data = self.held + self.decoder.bytes_of[token]
        state, done = _START, 0
        for at, x in enumerate(data):
            if (state, x) not in _MOVE:  # what came before is no character; this byte may begin one
                done, state = at, _START
            state = _MOVE.get((state, x), _START)
            if state == _START:
                done = at + 1
        move = self[token] = self.decoder.state(data[done:]), data[:done]
        return move


class TokenBytes:
    """The decoding machine of a vocabulary: its states and transitions met so far."""

    def __init__(self, bytes_of: dict[int, bytes]):
        self.bytes_of = bytes_of
        self.states: dict[bytes, _Held] = {}

    def state(self, held: bytes) -> _Held:
        found = self.states.get(held)
        if found is None:
            found = self.states[held] = _Held()
            found.decoder, found.held = self, held
        return found


class StreamDecoder:
    """Bytes of ids fed in pieces, handed out up to the last finished character: each piece may be
    decoded as UTF-8 by itself. A character split between tokens waits for its rest."""

    def __init__(self, machine: TokenBytes):
        self.machine, self.now = machine, machine.state(b"")

    def feed(self, ids) -> bytes:
        out, state = [], self.now
        for token in ids:
            state, done = state[token]
            out.append(done)
        self.now = state
        return b"".join(out)

    def finish(self) -> bytes:
        held, self.now = self.now.held, self.machine.state(b"")
        return held


class Remembered:
    """Values by key, computed once. Holds the keys of late: at most twice `size`, the most used among them."""

    def __init__(self, compute, size: int):
        self.compute, self.size = compute, size
        self.young: dict = {}
        self.old: dict = {}

    def add(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        if len(self.young) >= self.size:
            self.old = self.young.copy()
            self.young.clear()  # the same dict, which callers look into
        self.young[key] = value
        return value


class Splitter:
    """findall() of a pattern of the regex library.

    The standard library's machine is faster, but knows no properties: they become the code points up
    to U+FFFF for which the regex library says so. Texts with others, and patterns with further
    escapes, flags or groups, are left to the regex library.
    """

    def __init__(self, pattern: str):
        self.exact = self.quick = regex.compile(pattern).findall
        every = "".join(map(chr, range(65536)))
        codes = {k: "".join(f"\\u{ord(m[0][0]):04x}-\\u{ord(m[0][-1]):04x}" for m in regex.finditer(f"{k}+", every)) for k in (r"\p{L}", r"\p{N}", r"\s")}
        plain = re.sub(r"\[\^?(?:\\s|\\p\{[LN]\})+\]", lambda m: re.sub(r"\\s|\\p\{[LN]\}", lambda k: codes[k[0]], m[0]), pattern)
        for k, v in codes.items():
            plain = plain.replace(k, f"[{v}]")
        plain = plain.replace(r"\S", f"[^{codes[r'\s']}]")
        if not re.search(r"\\[^u]|\(\?(?![!=:])|\(\*", plain):
            self.quick = re.compile(plain).findall

    def findall(self, text: str) -> list[str]:
        low = text.isascii() or len(text.encode("utf-16-le", "surrogatepass")) == 2 * len(text)
        return (self.quick if low else self.exact)(text)


def machine(data: bytes, pattern: str) -> tuple[Transducer, TokenBytes, Splitter, Remembered]:
    """One machine a worker process, shared by its tasks, with the pre-tokens encoded so far: their ids
    as decimals joined by commas, and the bytes that the decoder hands out for these ids.

    A pre-token is whole characters, so the decoder is at its beginning before and after it.
    """

    def make():
        fst = Transducer(read_ranks(data))
        decoding = TokenBytes(fst.bytes_of)

        def piece(p: str) -> tuple[str, bytes]:
            ids = fst.encode(p.encode("utf-8", "replace"))
            decoder = StreamDecoder(decoding)
            return ",".join(map(str, ids)), decoder.feed(ids) + decoder.finish()

        return fst, decoding, Splitter(pattern), Remembered(piece, MAX_PIECES)

    return kept(hashlib.sha256(data + pattern.encode()).digest(), make)


#: Encoded pre-tokens that a worker remembers, twice: the last ones and those before.
MAX_PIECES = 150_000

def bpe_encode(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Encodes every text and decodes the ids again.

    Returns doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas), decoded_sha256 (of
    the decoded bytes) and, unless with_ids is False, ids. A null text counts as empty: no ids, the
    digests of nothing. Null and repeated doc_ids keep their rows; other columns are ignored. A lone
    surrogate, which UTF-8 cannot hold, is encoded as U+FFFD.
    """
    spark = docs.sparkSession
    with open(rank_file, "rb") as f:
        ranks = spark.sparkContext.broadcast(f.read())  # a vocabulary: a few MB at most

    def start():
        _, _, splitter, known = machine(ranks.value, pattern)
        findall, sha256, get, add = splitter.findall, hashlib.sha256, known.young.get, known.add

        def work(rows):
            out = []
            for doc_id, text in rows:
                parts = [get(p) or add(p) for p in findall(text or "")]
                ids, decoded = zip(*parts, strict=True) if parts else ((), ())
                ids = ",".join(ids)
                row = (doc_id, ids.count(",") + 1 if ids else 0, sha256(ids.encode()).hexdigest(), sha256(b"".join(decoded)).hexdigest())
                out.append((*row, np.fromstring(ids, np.int32, sep=",")) if with_ids else row)
            return out

        return work

    schema = f"{id_col} long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return map_arrow(docs.select(id_col, text_col), schema, start, rows=128)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and digests of each document's ids and of the bytes decoded from them; a null text has none."""
    import public_tokenizers

    return bpe_encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False)
