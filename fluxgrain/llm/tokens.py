"""Token counts by a compiled finite-state transducer whose chunk maps compose.

The vocabulary of a byte-level BPE with word ends is compiled into a deterministic transducer over the letters of UTF-8 bytes. The
last token of a prefix's encoding is the one suffix of it that is a token and stays unmerged beside the last token of what precedes
it. So what a state must know is, for each suffix of the letters read that begins some token of the vocabulary: the last token
before that suffix, and how many tokens were emitted since. These are finitely many; equal ones are one state, whichever words
lead there. A transition goes to the state after one more letter and carries the change in the number of tokens emitted, which the
compiler reads off the accepted token; the last letter of a pre-token is a symbol of its own, whose transition settles the count
and returns to the start. States and transitions are entered when a text first needs them, and stay: there are about a quarter as
many as there are distinct words.

A chunk of the symbols of a text acts on the states: a map from the state before it to the state after it and the tokens emitted.
Maps compose associatively. Texts of more than CHUNK symbols are cut anywhere, inside words too, and counted by the parallel prefix
scan of their chunks' maps; shorter ones are one chunk, counted by stretches without white space, which all begin at the start state
and whose counts are kept in a table of bounded size.

Stretches with a special token's string, which the library turns into one token by default, are counted by the library, and
stretches with other letters than those of ASCII and Latin-1 are normalised and pre-tokenised by it before the transducer runs.

Defined cases: null text counts as empty and has 0 bytes and tokens; very long texts are counted whole; repeated rows are counted
each; an empty table gives an empty result; extra columns are ignored, whatever their names. The vocabulary's path is a parameter;
every executor must be able to read it.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from fluxgrain.llm.common import small_batches, utf8

#: Symbols of a chunk.
CHUNK = 1 << 16
#: Counts, neighbours of tokens and states that a table holds before it is emptied.
KEPT, MOST_STATES = 500_000, 2_000_000
LONGEST_KEPT = 48
END = "</w>"
#: The symbol of a letter that ends its pre-token is the letter's, raised by this.
LAST = 512
#: States and symbols in a transition's key, tokens emitted (offset by half of it) in its value.
SYMBOLS, SHIFT = 10, 8
HALF = 1 << SHIFT - 1

# fixed value: the vocabulary's own pre-token pattern, on printable ASCII and the letters of Latin-1, both lower case
_LATIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+")
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")


def byte_letters() -> list[str]:
    """The printable stand-in of each byte: itself where it is printable Latin-1, else the next free code point from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, free = [], 256
    for b in range(256):
        if b in plain:
            out.append(chr(b))
        else:
            out.append(chr(free))
            free += 1
    return out


#: Of each suffix that begins a token, longest first: the suffix, the last token before it, the tokens emitted since.
Chain = tuple[tuple[str, str, int], ...]


class Transducer:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("end_of_word_suffix") != END:
            raise ValueError("a BPE vocabulary with word ends is needed")
        specials = [re.escape(t["content"].encode()) for t in spec.get("added_tokens", []) if t.get("special")]
        self.special = re.compile(b"|".join(specials) or b"(?!)").search
        self.tokens = model["vocab"]
        self.rank = {tuple(m if isinstance(m, list) else m.split(" ")): i for i, m in enumerate(model["merges"])}
        bodies = [t.removesuffix(END) if len(t) > len(END) else t for t in self.tokens]
        self.begins = {t[:i] for t in bodies for i in range(len(t))}
        letters = byte_letters()
        self.letters = {c: "".join(letters[b] for b in chr(c).encode()) for c in range(256)}
        self.words: dict[str, int] = {}
        self.beside: dict[tuple[str, str], bool] = {}
        self.forget()

    def forget(self) -> None:
        """Back to the start state alone; the others come back as texts need them."""
        self.next: dict[int, int] = {}  # by state and symbol: state after it, and tokens emitted
        self.chains: list[Chain] = []
        self.known: dict[Chain, int] = {}
        self.state((("", "", 0),))

    def state(self, chain: Chain) -> int:
        if (found := self.known.get(chain)) is None:
            found = self.known[chain] = len(self.chains)
            self.chains.append(chain)
        return found

    def merged(self, parts: list[str]) -> list[str]:
        """BPE by its definition, for short strings."""
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.rank.get((parts[i], parts[i + 1]), 1 << 60))
            if (parts[best], parts[best + 1]) not in self.rank:
                break
            a, b = parts[best], parts[best + 1]
            out, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and parts[i] == a and parts[i + 1] == b:
                    out.append(a + b)
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    @staticmethod
    def symbols(token: str) -> list[str]:
        if token.endswith(END) and len(token) > len(END):
            body = token.removesuffix(END)
            return [*body[:-1], body[-1] + END]
        return list(token)

    def unmerged(self, a: str, b: str) -> bool:
        """Whether tokens a and b, in this order, are an encoding."""
        if (found := self.beside.get((a, b))) is None:
            if len(self.beside) > KEPT:
                self.beside.clear()
            found = self.beside[a, b] = self.merged(self.symbols(a) + self.symbols(b)) == [a, b]
        return found

    def transition(self, state: int, symbol: int) -> int:
        """The state after symbol and the tokens emitted, as entered in the table of transitions."""
        ends = symbol >= LAST
        letter = chr(symbol - LAST if ends else symbol)
        for suffix, last, since in self.chains[state]:
            token = suffix + letter + END * ends
            if token in self.tokens and (not last or self.unmerged(last, token)):
                break
        else:
            raise ValueError(f"{letter!r} has no encoding")
        emitted = 1 - since  # the tokens since the suffix began give way to the accepted one
        to = 0
        if not ends:
            chain = [(s + letter, before, n + emitted) for s, before, n in self.chains[state] if s + letter in self.begins]
            to = self.state((*chain, ("", token, 0)))
        found = self.next[state << SYMBOLS | symbol] = to << SHIFT | (emitted + HALF)
        return found

    def run(self, state: int, symbols: str) -> tuple[int, int]:
        """The state after symbols and the tokens emitted."""
        n, table = 0, self.next
        for x in symbols:
            found = table.get(state << SYMBOLS | ord(x)) or self.transition(state, ord(x))
            state = found >> SHIFT
            n += (found & 2 * HALF - 1) - HALF
        return state, n

    def pretokens(self, raw: bytes) -> list[str]:
        """The pre-tokens of a stretch without white space and special tokens, in the letters of byte_letters()."""
        text = raw.decode()
        if _PLAIN.fullmatch(text):
            parts = _LATIN.findall(text.lower())
            return parts if raw.isascii() else [x.translate(self.letters) for x in parts]
        return [x for x, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))]

    def by_library(self, raw: bytes) -> int:
        return len(self.library.encode(raw.decode(), add_special_tokens=False).ids)

    def stretch(self, raw: bytes) -> int:
        """Tokens of a stretch without white space."""
        if not raw:
            return 0
        return self.by_library(raw) if self.special(raw) else sum(map(self.word, self.pretokens(raw)))

    def word(self, x: str) -> int:
        """Tokens of one pre-token, kept up to a bounded number."""
        if (n := self.words.get(x)) is None:
            if len(self.chains) > MOST_STATES:
                self.forget()
            n = self.run(0, symbols_of(x))[1]
            if len(x) <= LONGEST_KEPT:
                if len(self.words) > KEPT:
                    self.words.clear()
                self.words[x] = n
        return n


class Stretches(dict):
    """Counts of stretches, kept up to a bounded number."""

    def __init__(self, transducer: Transducer):
        super().__init__()
        self.transducer = transducer

    def __missing__(self, raw: bytes) -> int:
        n = self.transducer.stretch(raw)
        if len(raw) <= LONGEST_KEPT:
            if len(self) >= KEPT:
                self.clear()
            self[raw] = n
        return n


class Map:
    """What a chunk of symbols does to the states: the state after it and the tokens emitted, entered for the states that it meets."""

    def __init__(self, act: Callable[[int], tuple[int, int]]):
        self.act = act
        self.seen: dict[int, tuple[int, int]] = {}

    def __call__(self, state: int) -> tuple[int, int]:
        if (found := self.seen.get(state)) is None:
            found = self.seen[state] = self.act(state)
        return found


def chunk_map(symbols: str, t: Transducer) -> Map:
    """The map of a chunk. After its first end of a pre-token it does the same to every state, which is worked out once."""
    first = next((i for i, x in enumerate(symbols) if ord(x) >= LAST), None)
    if first is None:
        return Map(lambda state: t.run(state, symbols))
    to, n = t.run(0, symbols[first + 1 :])
    return Map(lambda state: (to, n + t.run(state, symbols[: first + 1])[1]))


def compose(x: Map, y: Map) -> Map:
    def act(state: int) -> tuple[int, int]:
        between, n = x(state)
        after, m = y(between)
        return after, n + m

    return Map(act)


def scan(maps: list[Map]) -> list[Map]:
    """All prefix products of maps, by doubling."""
    step = 1
    while step < len(maps):
        maps = [compose(maps[i - step], m) if i >= step else m for i, m in enumerate(maps)]
        step *= 2
    return maps


def symbols_of(pretoken: str) -> str:
    return pretoken[:-1] + chr(ord(pretoken[-1]) + LAST)


def count_text(raw: bytes, f: Stretches, chunk: int = CHUNK) -> int:
    if len(raw) <= chunk:
        return sum(map(f.__getitem__, raw.split()))  # one chunk: its stretches all begin at the start state
    t = f.transducer
    if len(t.chains) > MOST_STATES:
        t.forget()
    apart, parts = 0, []
    for x in raw.split():
        if t.special(x):
            apart += t.by_library(x)
        else:
            parts += map(symbols_of, t.pretokens(x))
    symbols = "".join(parts)
    maps = [chunk_map(symbols[i : i + chunk], t) for i in range(0, len(symbols), chunk)]
    return apart + (scan(maps)[-1](0)[1] if maps else 0)


_compiled: dict[str, Stretches] = {}


def counter(path: str, limit: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _compiled:
            _compiled[path] = Stretches(Transducer(path))
        f = _compiled[path]
        for batch in batches:
            data, off = utf8(batch.column("text"))
            view = memoryview(data)
            n = np.array([count_text(bytes(view[a:b]), f) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)], np.int64)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_bytes": pa.array(np.diff(off)), "n_tokens": pa.array(n), "over_limit": pa.array(n > limit)})

    return run


def token_counts(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of docs."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(counter(path, limit), f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
