"""BPE encoding by a bounded-lookahead streaming transducer, and incremental decoding.

A token sequence is the BPE result of a pre-token exactly if every adjacent pair of it is
the BPE result of the two tokens' own concatenation. So the result of a prefix is described
by its last token and the (shorter) prefix before it, and all prefixes form a tree. A
position is *live* while some vocabulary token could still span it; tokens before the
deepest common ancestor of all live positions can never change and are emitted. Past the
longest token no position is live, which bounds the lookahead.

The state of the transducer is the last emitted token and the symbols after it. Transitions
are built on first use and kept in a bounded table, so memory does not grow with the text.
"""

from __future__ import annotations

import functools
import hashlib
import json
import unicodedata
from collections.abc import Iterable, Iterator
from itertools import chain

import regex
from pyspark.sql import DataFrame

from wakeline.llm.common import map_rows, text_or_empty

#: Unicode White_Space, which the tokenizer files' ``\s`` stands for.
SPACE = "\t-\r \x85\xa0  -     　"
_SPACES = regex.compile(f"[{SPACE}]+")
_ODD_SPACE = regex.compile("[\x1c-\x1f]")
#: Sizes of the per-task tables; they are emptied when full, results do not depend on them.
MAX_STATES, MAX_WORDS, MAX_PAIRS = 200_000, 300_000, 250_000
#: Whitespace-free stretches longer than this are not kept in the word table.
MAX_KEPT_CHARS = 64
#: Characters that are encoded, hashed and decoded at a time.
BLOCK_CHARS = 1 << 16


@functools.cache
def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class _State(dict):
    """symbol -> (token that then ends the prefix, next state); ``ends``: the same for a last symbol.

    ``live`` has, for each live position, where it lies in ``tail`` and the last token
    before it; ``tail`` holds the symbols from the first live position on.
    """

    __slots__ = ("ends", "live", "owner", "tail")

    def __init__(self, owner: Transducer, tail: str, live: tuple):
        self.owner, self.tail, self.live, self.ends = owner, tail, live, {}

    def __missing__(self, symbol: str):
        owner, tail = self.owner, self.tail + symbol
        token = owner._last_token(self.live, tail)
        live = [x for x in self.live if tail[x[0]:] in owner.prefixes]
        live.append((len(tail), token))
        first = live[0][0]
        self[symbol] = got = token, owner._state(tail[first:], tuple((k - first, t) for k, t in live))
        return got

    def end(self, symbol: str) -> str:
        got = self.ends.get(symbol)
        if got is None:
            got = self.ends[symbol] = self.owner._last_token(self.live, self.tail + symbol, self.owner.suffix)
        return got


class Transducer:
    """BPE of single pre-tokens, given as strings of byte symbols."""

    def __init__(self, vocab: dict[str, int], merges: Iterable[tuple[str, str]], suffix: str = ""):
        self.vocab, self.suffix = vocab, suffix
        self.ranks = {tuple(m): i for i, m in enumerate(merges)}
        bare = [t.removesuffix(suffix) if suffix else t for t in vocab]
        #: Symbols after which no token can reach back: the sufficient lookahead.
        self.lookahead = max(map(len, bare))
        self.prefixes = {t[:k] for t in bare for k in range(1, len(t))}
        self._spans = {t: (i, len(b)) for (t, i), b in zip(vocab.items(), bare)}
        self._pairs: dict[tuple[str | None, str], bool] = {}
        self._states: dict[tuple, _State] = {}
        self.start = _State(self, "", ((0, None),))

    def merge(self, symbols: list[str]) -> list[str]:
        """Plain BPE of a short list of symbols; decides which tokens may be neighbours."""
        symbols = list(symbols)
        while len(symbols) > 1:
            rank, at = min((self.ranks.get(p, 1 << 60), i) for i, p in enumerate(zip(symbols, symbols[1:])))
            if rank == 1 << 60:
                break
            symbols[at:at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def _split(self, token: str) -> list[str]:
        if self.suffix and token.endswith(self.suffix):
            bare = token[:-len(self.suffix)]
            return [*bare[:-1], bare[-1] + self.suffix]
        return list(token)

    def neighbours(self, left: str | None, right: str) -> bool:
        got = self._pairs.get((left, right))
        if got is None:
            if len(self._pairs) >= MAX_PAIRS:
                self._pairs.clear()
            parts = [right] if left is None else [left, right]
            got = self._pairs[left, right] = self.merge([s for p in parts for s in self._split(p)]) == parts
        return got

    def _last_token(self, live: tuple, tail: str, suffix: str = "") -> str:
        """The one token from a live position to the end of ``tail`` that fits what is before it."""
        for k, before in live:
            token = tail[k:] + suffix
            if token in self.vocab and self.neighbours(before, token):
                return token
        raise ValueError(f"the vocabulary lacks a symbol of {tail!r}")

    def _state(self, tail: str, live: tuple) -> _State:
        got = self._states.get((tail, live))
        if got is None:
            if len(self._states) >= MAX_STATES:  # states in use stay valid until let go
                self._states.clear()
                self.start.clear()
            got = self._states[tail, live] = _State(self, tail, live)
        return got

    def _length(self, token: str) -> int:
        return self._spans[token][1]

    def _ids(self, links: list[str], start: int, at: int) -> list[int]:
        """Ids of the tokens from position ``start`` to ``at``, along the tree of prefixes."""
        out, spans = [], self._spans
        while at > start:
            number, length = spans[links[at - 1]]
            out.append(number)
            at -= length
        out.reverse()
        return out

    def stream(self, symbols: Iterable[str]) -> Iterator[int]:
        """Ids of one pre-token of any length, as soon as they are certain.

        Every ``4 * lookahead`` symbols the deepest common ancestor of the live positions is
        found, what lies before it is emitted and forgotten.
        """
        state, held, links = self.start, None, []
        for symbol in symbols:
            if held is not None:
                token, state = state[held]
                links.append(token)
                if len(links) % (4 * self.lookahead) == 0:
                    live = {len(links) - len(state.tail) + k for k, _ in state.live}
                    while len(live) > 1:  # move the deepest up until all meet
                        at = max(live)
                        live.remove(at)
                        live.add(at - self._length(links[at - 1]))
                    cut = live.pop()
                    yield from self._ids(links, 0, cut)
                    del links[:cut]
            held = symbol
        if held is not None:
            links.append(state.end(held))
            yield from self._ids(links, 0, len(links))

    def encode(self, symbols: str) -> tuple[int, ...]:
        if len(symbols) > 8 * self.lookahead:
            return tuple(self.stream(symbols))
        if not symbols:
            return ()
        state, links = self.start, []
        for symbol in symbols[:-1]:
            token, state = state[symbol]
            links.append(token)
        links.append(state.end(symbols[-1]))
        return tuple(self._ids(links, 0, len(links)))


class _Words(dict):
    """Whitespace-free stretch -> ids."""

    def __init__(self, owner: WordBpe):
        self.owner = owner

    def __missing__(self, stretch: str) -> tuple[int, ...]:
        owner = self.owner
        if stretch.isalpha():  # one pre-token; words beside punctuation are looked up as well
            ids = owner.word(stretch)
        else:
            found = owner.pattern.findall(stretch)
            ids = tuple(chain.from_iterable([self[w] if w.isalpha() else owner.word(w) for w in found]))
        if len(stretch) <= MAX_KEPT_CHARS:
            if len(self) >= MAX_WORDS:
                self.clear()
            self[stretch] = ids
        return ids


class WordBpe:
    """A tokenizer file with NFC, lower case, word pattern and end-of-word marks.

    Special tokens written in a text are recognised before anything else, as the library does.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pattern = regex.compile(pattern.replace(r"\s", SPACE))
        self.transducer = Transducer(self.vocab, map(tuple, model["merges"]), model["end_of_word_suffix"] or "")
        self.has_decoder = spec.get("decoder") is not None
        self._bytes = byte_symbols()
        self._words = _Words(self)
        self.tokens = {i: t for t, i in [*self.vocab.items(), *self.special.items()]}

    def word(self, word: str) -> tuple[int, ...]:
        if word.isascii() and word.isprintable():  # stands for itself
            return self.transducer.encode(word)
        table = self._bytes
        return self.transducer.encode("".join([table[b] for b in word.encode("utf-8")]))

    @staticmethod
    def stretches(text: str) -> list[str]:
        if not text.isascii() and not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        if _ODD_SPACE.search(text):  # these separate words for str.split only
            return [s for s in _SPACES.split(text.replace("Σ", "σ").lower()) if s]
        return text.replace("Σ", "σ").lower().split()

    def blocks(self, text: str) -> Iterator[list[int]]:
        """Ids of a text, a bounded block of words at a time."""
        for part in self._special.split(text):
            if part in self.special:
                yield [self.special[part]]
                continue
            words = self.stretches(part)
            step = BLOCK_CHARS // 8
            for at in range(0, len(words), step):
                yield list(chain.from_iterable(map(self._words.__getitem__, words[at:at + step])))


class ByteText:
    """Incremental byte-to-text machine: bytes of tokens in, whole characters out.

    Broken sequences become U+FFFD, one for each maximal part of a character.
    """

    def __init__(self):
        import codecs

        self._machine = codecs.getincrementaldecoder("utf-8")("replace")
        self._bytes = {s: b for b, s in enumerate(byte_symbols())}

    def feed(self, token: str, suffix: str = "") -> str:
        word_end = bool(suffix) and token.endswith(suffix)
        bare = token[:-len(suffix)] if word_end else token
        return self._machine.decode(bytes(self._bytes[s] for s in bare)) + (" " if word_end else "")

    def finish(self) -> str:
        return self._machine.decode(b"", final=True)


class Decoder:
    """Incremental decoder of a file: ids in, text out, holding at most one broken character.

    A file with a decoder part has byte symbols, and its tokens go through :class:`ByteText`. Without
    one the library joins the tokens' own strings by one space, and so does this.
    """

    def __init__(self, bpe: WordBpe):
        self._name, self._suffix = bpe.tokens.__getitem__, bpe.transducer.suffix
        self._machine = ByteText() if bpe.has_decoder else None
        self._begun = False

    def feed(self, ids: list[int]) -> str:
        if self._machine is not None:
            return "".join([self._machine.feed(self._name(i), self._suffix) for i in ids])
        text = " ".join(map(self._name, ids))
        if self._begun and ids:
            text = " " + text
        self._begun = self._begun or bool(ids)
        return text

    def finish(self) -> str:
        return "" if self._machine is None else self._machine.finish()


@functools.lru_cache(maxsize=2)
def codec(path: str) -> WordBpe:
    """One codec per file and Python worker, whose tables stay warm from task to task."""
    return WordBpe(path)


def encode_decode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): token count and digests of ids and decoded text.

    The file has no decoder part, for which the library joins the tokens' own strings by one
    space; the decoded digest is taken over that. Null text counts as empty, which has no
    tokens and the digests of the empty string. Repeated rows give repeated results; other
    columns are ignored.
    """

    def make():
        bpe = codec(tokenizer)
        numbers = {i: str(i) for i in bpe.tokens}.__getitem__

        def work(columns):
            counts, of_ids, of_text = [], [], []
            for text in columns[1]:
                n, ids_sum, text_sum, decoder = 0, hashlib.sha256(), hashlib.sha256(), Decoder(bpe)
                for ids in bpe.blocks(text):
                    if ids:
                        if n:
                            ids_sum.update(b" ")
                        n += len(ids)
                        ids_sum.update(" ".join(map(numbers, ids)).encode())
                        text_sum.update(decoder.feed(ids).encode())
                text_sum.update(decoder.finish().encode())
                counts.append(n)
                of_ids.append(ids_sum.hexdigest())
                of_text.append(text_sum.hexdigest())
            return [columns[0], counts, of_ids, of_text]

        return work

    return map_rows(docs.select("doc_id", text_or_empty().alias("text")), make,
                    "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
