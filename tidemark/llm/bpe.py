"""BPE as a streaming transducer with bounded lookahead, and an incremental decoder.

**Lookahead.** Take a text and a longer text that begins with it, and apply the merge rules in order. Let
the frontier be the end of the prefix on which both agree. A rule u+v can move the frontier back by |u|
only if u is the last agreed token and v starts behind the frontier in one text only. After a step by
u+v, whatever starts at the frontier begins with u; so a later rule u'+v' can move it on only if its v'
begins with u. The farthest that any chain of rules, in rising order, moves the frontier is therefore a
longest path, found in one pass over the merge list: that is the sufficient lookahead. Tokens that end at
least that many symbols before the end of what has been read are final, and as no merge crosses the end of
a final token, what follows is encoded on its own.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import batched

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm.common import pieces

#: Letters and white space for which the fast path needs no tables: ASCII and the letters of Latin-1.
LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"
UNUSUAL = re.compile(f"[^\\t\\n\\r\\x20-\\x7e{LATIN}]")
#: Distinct pieces in one generation of a worker's memory; it holds two.
REMEMBERED = 250_000
#: Tokens that are held before the digests and the decoder get them; characters of a long text split at a time.
HELD, BLOCK = 4096, 1 << 16
#: A piece longer than this streams through the transducer and is not remembered.
LONG_PIECE = 256
NEVER = 1 << 62


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies.

    Fixed rule: printable Latin-1 characters stand for themselves, the others follow from code point 256.
    """
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    extra = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(extra)) for b in range(256)]


class Merges:
    """A merge list over symbol ids, with its sufficient lookahead."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]) -> None:
        self.vocab = vocab
        #: Pair of ids -> rank and result in one number, so that the smallest is the next merge.
        self.rules = {
            vocab[u] << 32 | vocab[v]: rank << 32 | vocab[u + v] for rank, (u, v) in reversed([*enumerate(merges)])
        }
        self.lookahead = self._lookahead(merges)

    @staticmethod
    def _lookahead(merges: list[tuple[str, str]], end: str = "</w>") -> int:
        """Symbols that any chain of rules can move the frontier back, plus the symbol that holds a word's end."""
        size = lambda token: len(token.removesuffix(end))
        best: dict[str, int] = {}
        longest = 0
        for u, v in merges:
            before = max((best.get(v[:n], 0) for n in range(1, len(v) + 1)), default=0)
            best[u] = max(best.get(u, 0), size(u) + before)
            longest = max(longest, best[u])
        return longest + 1

    def apply(self, symbols: list[int]) -> list[int]:
        """All merges over a bounded list of symbols, lowest rank first and leftmost among equals."""
        rules, ids = self.rules, symbols
        ranks = [rules.get(a << 32 | b, NEVER) for a, b in zip(ids, ids[1:], strict=False)]
        while ranks:
            low = min(ranks)
            if low == NEVER:
                break
            at = ranks.index(low)
            ids[at : at + 2] = [low & 0xFFFFFFFF]
            del ranks[at]
            if at:
                ranks[at - 1] = rules.get(ids[at - 1] << 32 | ids[at], NEVER)
            if at < len(ranks):
                ranks[at] = rules.get(ids[at] << 32 | ids[at + 1], NEVER)
        return ids


class Transducer:
    """Reads symbols bit by bit and gives tokens as soon as no further symbol can change them.

    Holds at most `block` symbols and the lookahead, however long the piece is.
    """

    def __init__(self, merges: Merges, sizes: list[int], block: int | None = None) -> None:
        self.merges, self.sizes = merges, sizes
        self.block = block or max(64, merges.lookahead)
        self.held: list[int] = []

    def push(self, symbols: Iterable[int]) -> Iterator[int]:
        for symbol in symbols:
            self.held.append(symbol)
            if len(self.held) >= self.block + self.merges.lookahead:
                yield from self._stable()

    def finish(self) -> Iterator[int]:
        yield from self.merges.apply(self.held)
        self.held = []

    def _stable(self) -> Iterator[int]:
        limit, done = len(self.held) - self.merges.lookahead, 0
        for token in self.merges.apply(list(self.held)):
            if done + self.sizes[token] > limit:
                break
            done += self.sizes[token]
            yield token
        del self.held[:done]


class ByteText:
    """Incremental bytes to text: keeps the bytes of an unfinished character; bad bytes become U+FFFD."""

    def __init__(self) -> None:
        import codecs

        self.machine = codecs.getincrementaldecoder("utf-8")("replace")

    def push(self, data: bytes, last: bool = False) -> str:
        return self.machine.decode(data, last)


class Codec:
    """Encoder and decoder read from a tokenizer's file: added tokens, normaliser, splitting, merges, decoder."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        if model["type"] != "BPE":
            raise ValueError(f"not a BPE tokenizer: {model['type']}")
        self.end = model.get("end_of_word_suffix") or ""
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.merges = Merges(model["vocab"], pairs)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.added_split = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) or "(?!)")
        self.tokens = {i: t for t, i in (*model["vocab"].items(), *self.added.items())}
        top = max(self.tokens) + 1
        self.texts = [self.tokens.get(i, "") for i in range(top)]
        self.numbers = [str(i) for i in range(top)]
        self.sizes = [len(t.removesuffix(self.end) if self.end else t) for t in self.texts]
        self.byte_level_decoder = (spec.get("decoder") or {}).get("type") == "ByteLevel"
        self.symbols = byte_symbols()
        self.symbol_ids = [model["vocab"][s] for s in self.symbols]
        self.last_ids = [model["vocab"][s + self.end] for s in self.symbols]
        self.byte_of = {s: b for b, s in enumerate(self.symbols)}
        # Splitting and normalising of unusual characters follow the file's own rules.
        library = Tokenizer.from_file(path)
        self.normalizer, self.splitter = library.normalizer, library.pre_tokenizer
        self.quick = self._quick_split(spec)
        self.recent: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def _quick_split(self, spec: dict) -> re.Pattern | None:
        """The splitting pattern for usual characters, if the file's rules are those that it stands for."""
        steps = (spec.get("normalizer") or {}).get("normalizers", [])
        split = next((s for s in (spec["pre_tokenizer"] or {}).get("pretokenizers", []) if s["type"] == "Split"), {})
        wanted = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
        if [s["type"] for s in steps] != ["NFC", "Replace", "Lowercase"]:
            return None
        if split.get("pattern", {}).get("Regex") != wanted or split.get("behavior") != "Removed":
            return None
        return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LATIN}]+|[0-9]|[^\\s0-9{LATIN}]+")

    def _split(self, part: str) -> list[str]:
        return [*self._pieces(part)]

    def _pieces(self, part: str) -> Iterator[str]:
        """Pre-tokens one after the other; of a long text a block at a time is normalised and split."""
        for block in self._blocks(part):
            if self.quick and not UNUSUAL.search(block):
                yield from self.quick.findall(block.lower())
                continue
            text = self.normalizer.normalize_str(block) if self.normalizer else block
            for piece, _ in self.splitter.pre_tokenize_str(text):
                yield bytes(self.byte_of[c] for c in piece).decode("utf-8", "surrogateescape")

    def _blocks(self, part: str) -> Iterator[str]:
        """A text whose white space is dropped is cut before spaces, which nothing composes or is split with."""
        at = 0
        while self.quick and len(part) - at > BLOCK:
            cut = part.find(" ", at + BLOCK)
            if cut < 0:
                break
            yield part[at:cut]
            at = cut
        yield part[at:]

    def _symbols(self, piece: str) -> Iterator[int]:
        data = piece.encode("utf-8", "surrogateescape")
        ids = self.symbol_ids
        for byte in data[:-1]:
            yield ids[byte]
        yield (self.last_ids if self.end else ids)[data[-1]]

    def _piece(self, piece: str) -> Iterable[int]:
        """A piece's tokens as the transducer gives them; short pieces are remembered."""
        stream = Transducer(self.merges, self.sizes)
        if len(piece) > LONG_PIECE:
            return (token for part in (stream.push(self._symbols(piece)), stream.finish()) for token in part)
        found = (*stream.push(self._symbols(piece)), *stream.finish())
        if len(self.recent) >= REMEMBERED:
            self.older, self.recent = self.recent, {}
        self.recent[piece] = found
        return found

    def stream(self, text: str) -> Iterator[Iterable[int]]:
        """The tokens of a text, piece by piece, each as soon as no later symbol can change it."""
        recent, at = self.recent, 0
        for mark in (*self.added_split.finditer(text), None):
            for piece in self._pieces(text[at : mark.start()] if mark else text[at:]):
                found = recent.get(piece)
                if found is None:
                    found = self.older.get(piece)
                    if found is None:
                        found = self._piece(piece)
                        recent = self.recent
                    else:
                        recent[piece] = found
                yield found
            if mark:
                yield (self.added[mark[0]],)
                at = mark.end()

    def encode(self, text: str) -> list[int]:
        """All tokens of a text at once."""
        return [token for piece in self.stream(text) for token in piece]

    def decode(self, ids: Iterable[int], block: int = 4096) -> Iterator[str]:
        """Text in parts, from ids as they come. Without a decoder in the file, tokens are shown as they are, a space
        between them."""
        decoder = Decoder(self)
        for part in batched(ids, block):
            yield decoder.push(part)
        yield decoder.finish()


class Decoder:
    """State machine from ids to text: what has been shown, or the bytes of an unfinished character."""

    def __init__(self, own: Codec) -> None:
        self.own, self.first, self.machine = own, True, ByteText()

    def push(self, ids: Iterable[int]) -> str:
        own = self.own
        shown = [own.texts[i] for i in ids]
        if not own.byte_level_decoder:
            text = ("" if self.first or not shown else " ") + " ".join(shown)
            self.first = self.first and not shown
            return text
        byte_of = own.byte_of
        return self.machine.push(b"".join(bytes((byte_of[c],)) if c in byte_of else c.encode() for c in "".join(shown)))

    def finish(self) -> str:
        return self.machine.push(b"", True)


class Digests:
    """Fed with tokens: their number, the digest of their ids, and that of the text decoded from them."""

    def __init__(self, own: Codec) -> None:
        self.own, self.decoder = own, Decoder(own)
        self.count, self.ids, self.text = 0, hashlib.sha256(), hashlib.sha256()

    def push(self, ids: list[int]) -> None:
        if ids:
            numbers = self.own.numbers
            self.ids.update(((" " if self.count else "") + " ".join([numbers[i] for i in ids])).encode())
            self.text.update(self.decoder.push(ids).encode())
            self.count += len(ids)

    def finish(self) -> tuple[int, str, str]:
        self.text.update(self.decoder.finish().encode())
        return self.count, self.ids.hexdigest(), self.text.hexdigest()


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode_decode(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False
) -> DataFrame:
    """One row per row of `docs`: id, n_tokens, ids_sha256, decoded_sha256, and the ids if asked for.

    A null or empty text has no tokens and the digests of the empty text. Repeated ids give a row each; a
    null id stays null. Other columns are ignored; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in pieces(batches):
            rows, tokens = [], []
            for text in batch.column(1).to_pylist():
                digests, kept, held = Digests(own), [], []
                for found in own.stream(text or ""):
                    if isinstance(found, tuple):
                        held += found
                    else:  # a long piece, of which tokens come one by one
                        for part in batched(found, HELD):
                            digests.push([*held, *part])
                            if with_ids:
                                kept += [*held, *part]
                            held = []
                    if len(held) >= HELD:
                        digests.push(held)
                        if with_ids:
                            kept += held
                        held = []
                digests.push(held)
                if with_ids:
                    tokens.append(kept + held)
                rows.append(digests.finish())
            columns = [batch.column(0)] + [pa.array(x, t) for x, t in zip(
                zip(*rows, strict=True), (pa.int64(), pa.string(), pa.string()), strict=True)]
            names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns.append(pa.array(tokens, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, schema).withColumnRenamed("id", id_col)
