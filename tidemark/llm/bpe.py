"""BPE encoding and decoding by a merge automaton.

The merges compile into a deterministic automaton over tokens whose paths are exactly
the token sequences that BPE produces. It starts as one state with a loop for every
base symbol; each merge (u, v) -> w applies a gadget: u now leads to a copy of its
target that lacks the arc v, and every state with an arc u also gets an arc w to
where v led. Every start of a word has one path, so the automaton read byte by byte
is deterministic too: ``ByteTable`` holds its transitions, and a word is encoded by
one table step for each byte and one step back for each token. Decoding emits the
labels of the arcs.

Nulls count as empty texts; empty texts have no tokens. Texts of any length are read
whole, repeated rows each give a row, and other columns are ignored. A tokenizer file
with another normalizer, splitter or decoder than the one stated here is an error.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from . import common

#: Fixed values of the byte-level alphabet: bytes shown as themselves; the others take code points from 256 on.
PLAIN_BYTES = (range(ord("!"), ord("~") + 1), range(0xA1, 0xAC + 1), range(0xAE, 0xFF + 1))
#: The normalizers and the splitter that ``Encoder`` follows, as a tokenizer file states them.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: What white space means to the vocabulary's normalizer.
SPACES = "\t\n\x0b\x0c\r \x85\xa0  -     　"
#: Characters that Python's str.split takes for white space and the normalizer does not.
ODD_SPACES = "\x1c\x1d\x1e\x1f"
#: Code points that the vocabulary's splitter doesn't know yet as letters or numbers, as [first, last].
UNKNOWN = (
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F),
    (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D),
    (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB),
    (0x11DF1, 0x11DF1), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF3), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA),
    (0x18D09, 0x18D20), (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168),
    (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE),
    (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F),
    (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
)
#: Lower case of letters newer than Python's own tables.
LOWER = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
LOWER |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}
#: Chunks and table states that a worker keeps at most; beyond, it starts anew.
REMEMBERED = 500_000
STATES = 250_000


def read_vocabulary(path: str) -> dict:
    """Vocabulary, merges and special tokens of a tokenizer file, read on the driver; their size is the vocabulary's."""
    with open(path, encoding="utf-8") as f:
        raw = json.load(f)
    model = raw["model"]
    normalizer, splitter = raw.get("normalizer") or {}, (raw.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    known = normalizer.get("normalizers") == NORMALIZERS and (splitter[0].get("pattern") or {}).get("Regex") == WORDS
    known = known and [x.get("type") for x in splitter] == ["Split", "ByteLevel"] and not splitter[1].get("add_prefix_space") and not splitter[1].get("use_regex")
    odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges") if model.get(k)]
    plain = not any(t.get(k) for t in raw.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip", "normalized"))
    if not known or odd or not plain or raw.get("decoder"):
        raise ValueError(f"{path}: its normalizer, splitter, special tokens, model options {odd} or decoder are not those this encoder follows")
    return {
        "vocab": model["vocab"],
        "merges": [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]],
        "end": model.get("end_of_word_suffix") or "",
        "special": {t["content"]: t["id"] for t in raw.get("added_tokens", [])},
    }


class MergeAutomaton:
    """The token automaton after every merge's gadget.

    A copy that a gadget makes differs from its original in one arc, so no state is
    stored as a row: the state behind token a is what a's own gadgets took away, on
    top of what the gadgets of a's right part had taken away when a was born, and so
    on down. ``spine[a]`` lists those owners with the rank until which they count. A
    token born by a merge has an arc wherever its left part had one at that time;
    ``heads[b]`` lists b and its left parts with the ranks between which each decides.
    """

    def __init__(self, vocabulary: dict):
        vocab, end = vocabulary["vocab"], vocabulary["end"]
        self.label = {i: s for s, i in vocab.items()} | {i: s for s, i in vocabulary["special"].items()}
        size, last = max(self.label) + 1, len(vocabulary["merges"])
        self.spine = [((t, last),) for t in range(size)]
        self.heads = [((t, -1, last),) for t in range(size)]
        self.lost: dict[int, int] = {}
        self.dead: set[int] = set()
        for rank, (a, b) in enumerate(vocabulary["merges"]):
            self._gadget(rank, last, vocab[a], vocab[b], vocab[a + b])
        shown = {b: chr(b) for r in PLAIN_BYTES for b in r}
        hidden = [b for b in range(256) if b not in shown]
        raw = {c: b for b, c in shown.items()} | {chr(256 + k): b for k, b in enumerate(hidden)}
        self.inner, self.final = {}, {}
        for s, i in vocab.items():
            if i in self.dead:
                continue
            if end and s.endswith(end):
                self.final[bytes([raw[c] for c in s[: -len(end)]])] = i
            else:
                self.inner[bytes([raw[c] for c in s])] = i
        if not end:
            self.final = self.inner

    def _gadget(self, rank: int, last: int, u: int, v: int, w: int) -> None:
        """Merge (u, v) -> w: take the arc v from the state behind u, and lead w to where v led."""
        if u in self.dead or v in self.dead or not self.has_arc(u, v):
            self.dead.add(w)
            return
        self.lost[u << 20 | v] = rank
        (own, _), *rest = self.spine[v]
        self.spine[w] = ((w, last), (own, rank), *rest)
        (own, born, _), *rest = self.heads[u]
        self.heads[w] = ((w, rank, last), (own, born, rank), *rest)

    def has_arc(self, a: int, b: int) -> bool:
        """Whether the state behind token a has an arc b."""
        lost = self.lost
        for owner, until in self.spine[a]:
            for token, born, formed in self.heads[b]:
                rank = lost.get(owner << 20 | token)
                if rank is not None and rank < until and born < rank <= formed:
                    return False
        return True


class State(dict):
    """A row of the byte table: the next state for each byte, filled in at its first use.

    ``last`` is the last token of the path that ends here and ``final`` the one if the
    word ends here. ``open`` lists the tokens that may still be under way: their place in
    the tree of tokens and, in the low 20 bits, one more than the token before them.
    """

    __slots__ = ("table", "open", "last", "final")

    def __missing__(self, byte: int) -> State:
        found = self[byte] = self.table.step(self, byte)
        return found


class ByteTable:
    """The automaton's transitions by bytes. The states in use are bounded; beyond, the table starts anew."""

    def __init__(self, automaton: MergeAutomaton):
        self.automaton = automaton
        self.tree: list[dict[int, int]] = [{}]
        self.inner, self.final, self.size, self.packed = [-1], [-1], {}, {}
        for tokens, ends in ((automaton.inner, self.inner), (automaton.final, self.final)):
            for token, i in tokens.items():
                self.size[i], self.packed[i] = len(token), struct.pack("<I", i)
                node = 0
                for b in token:
                    to = self.tree[node].get(b)
                    if to is None:
                        to = self.tree[node][b] = len(self.tree)
                        self.tree.append({})
                        self.inner.append(-1)
                        self.final.append(-1)
                    node = to
                ends[node] = i
        self.states: dict[tuple, State] = {}
        self.clear()

    def clear(self) -> None:
        for state in self.states.values():  # they point at each other
            state.clear()
        self.states = {}
        self.arcs: dict[int, bool] = {}
        self.start = self._state((0,), -1, -1)

    def _state(self, open_: tuple, last: int, final: int) -> State:
        found = self.states.get((open_, final))
        if found is None:
            found = self.states[open_, final] = State()
            found.table, found.open, found.last, found.final = self, open_, last, final
        return found

    def has_arc(self, a: int, b: int) -> bool:
        key = a << 20 | b
        found = self.arcs.get(key)
        if found is None:
            found = self.arcs[key] = self.automaton.has_arc(a, b)
        return found

    def step(self, state: State, byte: int) -> State:
        tree, has_arc = self.tree, self.has_arc
        open_, last, final = [], -1, -1
        for place in state.open:
            to, before = tree[place >> 20].get(byte), (place & 0xFFFFF) - 1
            if to is None:
                continue
            if tree[to]:
                open_.append(to << 20 | before + 1)
            token = self.inner[to]
            if last < 0 <= token and (before < 0 or has_arc(before, token)):
                last = token
            token = self.final[to]
            if final < 0 <= token and (before < 0 or has_arc(before, token)):
                final = token
        if last >= 0:
            open_.append(last + 1)
        return self._state(tuple(open_), last, final)

    def encode(self, word: bytes) -> bytes:
        """Ids of a word, little-endian."""
        if len(self.states) > STATES:
            self.clear()
        state, size, packed = self.start, self.size, self.packed
        path = [state := state[b] for b in word]
        token, place = state.final, len(word)
        out = [packed[token]]
        while place := place - size[token]:
            token = path[place - 1].last
            out.append(packed[token])
        return b"".join(out[::-1])


class Encoder(dict):
    """Maps a chunk of text between spaces to its ids (little-endian); the chunks kept are bounded."""

    def __init__(self, vocabulary: dict):
        automaton = vocabulary["automaton"]
        self.table, self.label, self.special = ByteTable(automaton), automaton.label, vocabulary["special"]
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.mark = min((s[:2] for s in self.special), default="")
        unknown = "".join(f"{chr(a)}-{chr(b)}" for a, b in UNKNOWN)
        known = lambda kind: rf"[\p{{{kind}}}--[{unknown}]]"
        self.words = regex.compile("(?V1)" + WORDS.replace(r"[^\s\p{L}\p{N}]", rf"[^\s{known('L')}{known('N')}]").replace(r"[\p{L}]", known("L")).replace(r"[\p{N}]", known("N")))
        self.plain = re.compile(WORDS.replace(r"\p{L}", "a-z").replace(r"\p{N}", "0-9"), re.ASCII)  # the same for ASCII texts
        self.spaces = re.compile(f"[{SPACES}]+")

    def __missing__(self, chunk: str) -> bytes:
        text = chunk
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ").translate(LOWER)
        text = text.lower()
        encode, known = self.table.encode, self.get
        if text.isascii():
            words = [text] if text.isalpha() else self.plain.findall(text)
        else:
            words, known = self.words.findall(text), {}.get
        if len(self) >= REMEMBERED:
            self.clear()
        found = self[chunk] = b"".join([known(w) or encode(w.encode()) for w in words])
        return found

    def chunks(self, text: str) -> list[str]:
        if any(c in text for c in ODD_SPACES):
            return [x for x in self.spaces.split(text) if x]
        return text.split()

    def ids(self, text: str) -> bytes:
        if self.cut is None or self.mark not in text or not self.cut.search(text):
            return b"".join(map(self.__getitem__, self.chunks(text)))
        special = self.special
        return b"".join([struct.pack("<I", special[x]) if x in special else b"".join(map(self.__getitem__, self.chunks(x))) for x in self.cut.split(text)])

    def decode(self, ids: bytes) -> str:
        """Labels of the arcs, parted by spaces, as a tokenizer without a decoder gives them."""
        return " ".join(map(self.label.__getitem__, memoryview(ids).cast("I")))


def worker_encoder(shared) -> Encoder:
    """One encoder for each Python worker and vocabulary."""
    return common.remembered(shared.value["key"], lambda: Encoder(shared.value))


def compiled(path: str) -> dict:
    """A tokenizer file's automaton and special tokens, compiled on the driver."""
    vocabulary = read_vocabulary(path)
    key = f"{path}:{len(vocabulary['vocab'])}:{len(vocabulary['merges'])}"
    return {"key": key, "special": vocabulary["special"], "automaton": MergeAutomaton(vocabulary)}


_SHARED: dict[tuple, object] = {}


def share_vocabulary(spark, path: str):
    """Broadcast of a compiled vocabulary, one for each session and file; its size is that of the file, whatever the corpus."""
    key = (spark.sparkContext.applicationId, path)
    if key not in _SHARED:
        _SHARED[key] = spark.sparkContext.broadcast(compiled(path))
    return _SHARED[key]


def encode_documents(docs: DataFrame, vocabulary_path: str, ids: bool = False) -> DataFrame:
    """Encode and decode every text: ``doc_id, n_tokens, ids_sha256, decoded_sha256`` and, if asked for, ``ids, decoded``.

    No shuffle: each task reads its own split, and a worker keeps the words it has met.
    """
    shared = share_vocabulary(docs.sparkSession, vocabulary_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        encoder = worker_encoder(shared)
        for batch in batches:
            out = {k: [] for k in ("n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded")}
            for text in common.text_rows(batch):
                packed = encoder.ids(text)
                labels = encoder.decode(packed)
                out["n_tokens"].append(len(packed) // 4)
                out["ids_sha256"].append(hashlib.sha256(packed).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(labels.encode()).hexdigest())
                if ids:
                    out["ids"].append(memoryview(packed).cast("I").tolist())
                    out["decoded"].append(labels)
            yield out | {"doc_id": batch.column("doc_id")}

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<long>, decoded string" * ids
    return common.map_arrow(docs.select("doc_id", "text"), run, schema)
