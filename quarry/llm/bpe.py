"""BPE encoding and decoding as a streaming transducer with bounded lookahead.

For a fixed merge list every prefix of a word has exactly one encoding, and its last token
depends only on the last token of a shorter prefix: the pair of neighbours must be one that the
merges leave alone. So one back pointer per prefix is enough, and every continuation of a word
passes through one of the last ``lookahead`` prefixes, where ``lookahead`` is the longest token
the merge list can build. Tokens before the point in which the back pointers of that window
meet can no longer change: they are emitted and forgotten, so states do not grow with the word. A word
within the lookahead becomes stable at its end as a whole; its back pointers are followed from there. Ids are
decoded one by one as the tokenizer's file says; ``token_ids`` restores text by an incremental UTF-8 state machine.
A text is read in parts cut at white space; the tokens of one part (one word without white space at most) are held.

Results for special cases: null or empty text gives no tokens; strings of special tokens become
these tokens; bytes that are no UTF-8 become replacement characters; repeated rows give repeated rows; an empty table
gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
import sys
import unicodedata
from collections.abc import Iterable, Iterator

import regex
from pyspark.sql import DataFrame

from quarry.llm.common import map_texts

#: Fixed values of the tokenizer's format: end-of-word mark, word pattern, white space.
END = "</w>"
SPACE = r"\t-\r\x20\x85\xa0  -     　"
WORDS = rf"\p{{L}}+|'(?:[stmd]|re|ve|ll)|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+"
#: The same pattern over Latin-1 text, for the faster matcher.
LATIN_LETTER, LATIN_NUMBER = "a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe"
LATIN_WORDS = rf"[{LATIN_LETTER}]+|'(?:[stmd]|re|ve|ll)|[{LATIN_NUMBER}]|[^\t-\r\x20\x85\xa0{LATIN_LETTER}{LATIN_NUMBER}]+"
PIECE = 1 << 16  # code points of a text handled at a time
CACHED_WORDS = 300_000  # words kept with their encoding; later ones run through the transducer
CACHED_PAIRS = 100_000  # pairs of tokens whose neighbourhood is remembered
CACHED_STATES = 150_000  # states kept; beyond that the transducer is derived anew
LONG_WORD = 64  # bytes; longer words are encoded each time they occur


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself if it is a visible Latin-1
    character, else the next unused code point from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class State:
    """What the transducer remembers between symbols: the symbols after the last stable token
    and the last token of each prefix since then, that one first. ``step`` maps a byte, plus 256
    at the end of a word, to (stable tokens to emit, next state)."""

    __slots__ = ("last", "pending", "step")

    def __init__(self, last: tuple[str | None, ...], pending: str):
        self.last, self.pending, self.step = last, pending, {}


class Transducer:
    """Encoder of words for one merge list. ``spec`` is the parsed tokenizer file."""

    def __init__(self, spec: dict):
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.token = {i: t for t, i in self.vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token.update({i: t for t, i in self.special.items()})
        merges = [tuple(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        self.rank = {pair: r for r, pair in enumerate(merges)}
        self.made = {a + b: (r, a, b) for r, (a, b) in reversed(list(enumerate(merges)))}
        if len(self.made) < len(merges):
            raise ValueError("two merges build one token; back pointers would not be unique")
        self.alphabet = byte_alphabet()
        self.byte = {c: b for b, c in enumerate(self.alphabet)}
        bodies = [self.symbols(t) for t in self.vocab]
        self.lookahead = max(map(len, bodies))
        #: Texts that a longer token starts with: only from their start a later token can begin.
        self.begun = {"".join(t[:n]) for t in bodies for n in range(1, len(t))}
        self.words, self.latin_words = regex.compile(WORDS), re.compile(LATIN_WORDS)
        self.cuts = regex.compile("(" + "|".join(regex.escape(t) for t in self.special) + ")") if self.special else None
        self.space = regex.compile(f"[{SPACE}]")
        self.spines: dict[tuple[str, int], list[tuple[str, int]]] = {}  # two for a token at most
        self.states: dict[tuple[str | None, str], State] = {}
        self.start = self.state([""], "")
        self.known: dict[str, tuple[str, str]] = {}
        self.beside: dict[tuple[str, str], bool] = {}

    @staticmethod
    def symbols(token: str) -> list[str]:
        """Symbols of a token; the end-of-word mark belongs to the last one."""
        if token.endswith(END) and len(token) > len(END):
            body = token[: -len(END)]
            return [*body[:-1], body[-1] + END]
        return list(token)

    def spine(self, token: str, side: int) -> list[tuple[str, int]]:
        found = self.spines.get((token, side))
        if found is None:
            found = self.spines[token, side] = self.parts(token, side)
        return found

    def parts(self, token: str, side: int) -> list[tuple[str, int]]:
        """The parts of a token that touch its right (side 2) or left (1) end while it is
        built, each with the rank of the merge that takes it in."""
        out, taken = [(token, len(self.rank))], self.made.get(token)
        while taken:
            out.append((taken[side], taken[0]))
            taken = self.made.get(taken[side])
        return out

    def allowed(self, before: str, token: str) -> bool:
        """Whether the merges leave ``before`` and ``token`` side by side ("": word start):
        no merge joins two parts across the gap before each is taken in on its own side.
        Equal merges go from left to right, hence the two comparisons."""
        if not before:
            return True
        right = self.spine(before, 2)
        for b, b_until in self.spine(token, 1):
            for a, a_until in right:
                r = self.rank.get((a, b))
                if r is not None and r < a_until and r <= b_until:
                    return False
        return True

    def fits(self, before: str, token: str) -> bool:
        """``allowed``, remembered."""
        found = self.beside.get((before, token))
        if found is None:
            if len(self.beside) >= CACHED_PAIRS:
                self.beside.clear()
            found = self.beside[before, token] = self.allowed(before, token)
        return found

    def last_token(self, text: str, last: list[str | None], end: bool) -> str | None:
        """The last token of the prefix ``text``; ``last[-n]`` is the last token of the prefix
        that is n symbols shorter. None: it begins before the stable point, so no token that
        is still to come can follow this prefix."""
        mark = END if end else ""
        for n in range(min(len(text), self.lookahead), 0, -1):
            token = text[-n:] + mark
            if token in self.vocab and last[-n] is not None and self.fits(last[-n], token):
                return sys.intern(token)  # states share their tokens
        return None

    @staticmethod
    def back(last: list[str], at: int) -> list[str]:
        out = []
        while at > 0:
            out.append(last[at])
            at -= len(last[at])
        return out[::-1]

    def state(self, last: list[str | None], pending: str) -> State:
        key = (last[0], pending)
        found = self.states.get(key)
        if found is None:
            if len(self.states) >= CACHED_STATES:
                self.forget()
            found = self.states[key] = State(tuple(last), pending)
        return found

    def forget(self) -> None:
        """Drops what was derived; states refer to each other, so their links are cut."""
        for old in self.states.values():
            old.step.clear()
        self.states.clear()
        self.start.step.clear()

    def derive(self, state: State, key: int) -> tuple[tuple[str, str] | None, State | None]:
        """The transition of a state: ids and tokens that became stable, and the next state.
        The end of a word emits the rest."""
        end = key > 255
        last, text = list(state.last), state.pending + self.alphabet[key & 255]
        last.append(self.last_token(text, last, end))
        if end:
            tokens = [*self.back(last, len(text) - len(self.symbols(last[-1]))), last[-1]]
            nxt = None
        else:
            n = len(text)
            open_ends = {n} | {p for p in range(max(0, n - self.lookahead), n) if text[p:] in self.begun}
            while len(open_ends) > 1:  # back pointers of all prefixes that can go on
                at = max(open_ends)
                open_ends.remove(at)
                open_ends.add(at - len(last[at]))
            stable = open_ends.pop()
            tokens = self.back(last, stable)
            nxt = self.state(last[stable:], text[stable:])
        out = (" ".join([str(self.vocab[t]) for t in tokens]), " ".join(tokens)) if tokens else None
        state.step[key] = out, nxt
        return out, nxt

    def within(self, text: str) -> list[str]:
        """Tokens of a word that lies within the lookahead as a whole, so all of it becomes stable at its end: back
        pointers are followed from there, and only those of prefixes in question."""
        n, last = len(text), {0: ""}

        def ending(at: int) -> str | None:
            if at in last:
                return last[at]
            found = None
            mark = END if at == n else ""
            for begin in range(max(0, at - self.lookahead), at):
                token = text[begin:at] + mark
                if token in self.vocab and (before := ending(begin)) is not None and self.fits(before, token):
                    found = token
                    break
            last[at] = found
            return found

        out, at = [], n
        while at:
            out.append(ending(at))
            at -= len(out[-1]) - (len(END) if at == n else 0)
        return out[::-1]

    def word(self, word: str) -> tuple[str, str]:
        """Ids and decoded text of a word, collected as its tokens become stable."""
        raw = word.encode()
        if len(raw) <= min(self.lookahead, LONG_WORD):
            tokens = self.within("".join([self.alphabet[b] for b in raw]))
            ids = " ".join([str(self.vocab[t]) for t in tokens])
        else:
            ids = self.streamed(raw)
        found = ids, self.decoded(ids)
        if len(raw) <= LONG_WORD and len(self.known) < CACHED_WORDS:
            self.known[word] = found
        return found

    def decoded(self, ids: str) -> str:
        """The text of a run of ids as the tokenizer's file decodes them: it names no decoder, so tokens stand as
        they are, a space between two. One id at a time, nothing is kept."""
        return " ".join([self.token[int(i)] for i in ids.split(" ")])

    def streamed(self, raw: bytes) -> str:
        state, out = self.start, []
        for key in raw[:-1]:
            stable, state = state.step.get(key) or self.derive(state, key)
            if stable:
                out.append(stable)
        key = raw[-1] + 256
        out.append((state.step.get(key) or self.derive(state, key))[0])
        return " ".join([ids for ids, _ in out])

    def text(self, tokens: Iterable[str]) -> str:
        """Incremental decoding: bytes go through a UTF-8 state machine, an end mark is a space."""
        machine = codecs.getincrementaldecoder("utf-8")(errors="replace")
        out = []
        for token in tokens:
            if token in self.special:
                out.append(machine.decode(b"", True) + token)
                continue
            ended = token.endswith(END) and len(token) > len(END)
            body = token[: -len(END)] if ended else token
            out.append(machine.decode(bytes(self.byte[c] for c in body), ended) + " " * ended)
        return "".join(out) + machine.decode(b"", True)

    def pieces(self, text: str) -> Iterator[str]:
        """Parts of a text, each cut before white space, where no word or composition crosses."""
        at = 0
        while at < len(text):
            found = self.space.search(text, at + PIECE)
            end = found.start() if found else len(text)
            yield text[at:end]
            at = end

    def encode(self, text: str) -> Iterator[list[tuple[str, str]]]:
        """For each part of a text, (ids, tokens) of its words and special tokens."""
        get, word = self.known.get, self.word
        special = list(self.special)
        for piece in self.pieces(text):
            for part in self.cuts.split(piece) if any(t in piece for t in special) else (piece,):
                if part in self.special:
                    yield [(str(self.special[part]), part)]
                    continue
                split = self.latin_words.findall
                if not part.isascii():
                    part = unicodedata.normalize("NFC", part).replace("Σ", "σ")
                    if not latin(part):
                        split = self.words.findall
                found = [get(w) or word(w) for w in split(part.lower())]
                if found:
                    yield found


def load(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def digests(spec: dict):
    """Function of one text: number of tokens, digests of the ids and of the tokens as the
    library decodes them, joined by spaces."""
    coder = Transducer(spec)

    def of(raw: bytes) -> tuple[int, str, str]:
        n, ids_sum, tokens_sum, gap = 0, hashlib.sha256(), hashlib.sha256(), ""
        for part in coder.encode(raw.decode("utf-8", "replace")):
            ids = gap + " ".join([p[0] for p in part])
            n += ids.count(" ") + (not gap)
            ids_sum.update(ids.encode())
            tokens_sum.update((gap + " ".join([p[1] for p in part])).encode())
            gap = " "
        return n, ids_sum.hexdigest(), tokens_sum.hexdigest()

    of.close = coder.forget
    return of


def encode(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``id_col``, ``n_tokens`` and digests of each text; ``tokenizer`` is the path of a
    tokenizer file, read once by the driver and sent to the tasks."""
    spec = df.sparkSession.sparkContext.broadcast(load(tokenizer))
    fields = [("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string")]
    return map_texts(df, [id_col], lambda: digests(spec.value), fields, text)


def token_ids(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``id_col``, ``ids`` (decimal, joined by spaces) and ``restored`` text of each text."""
    spec = df.sparkSession.sparkContext.broadcast(load(tokenizer))

    def make():
        coder = Transducer(spec.value)

        def of(raw: bytes) -> tuple[str, str]:
            words = [w for part in coder.encode(raw.decode("utf-8", "replace")) for w in part]
            return " ".join([w[0] for w in words]), coder.text(t for w in words for t in w[1].split(" "))

        of.close = coder.forget
        return of

    return map_texts(df, [id_col], make, [("ids", "string"), ("restored", "string")], text)
