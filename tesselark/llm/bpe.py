"""Byte-level BPE encoding and decoding through a minimal acyclic transducer lexicon.

Encoding splits a text into words with a vectorised form of the byte-level pattern,
looks all words of a piece up at once in an automaton, and merges only the words that
the automaton doesn't hold.  The automaton is the minimal acyclic one of the most
frequent words (shared prefixes and shared suffixes).  Each transition carries how many
words sort before it, so the sum along a path is the word's number and the output is a
slice of one id array.  It is compiled once on the driver, packed into a double array,
shipped as one bounded block and memory-mapped by every Python worker, from memory and not
from a folder of the executor's machine.

Edge cases: a null or empty text has no ids; a null id is kept; repeated rows give
repeated results; a text that contains an added token's string gets that token's id, as
the tokenizers library does by default; a very long text is encoded whole, and takes memory
in proportion to its length; words tie for the lexicon's last places by their count's class,
of which all or none enter, which changes no id; an empty table gives an empty result;
columns beside id and text play no part, whatever their names.
"""

from __future__ import annotations

import contextlib
import hashlib
import heapq
import json
import mmap
import os
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_text, pieces, ragged, stored, utf8

#: Words that the lexicon holds at most; the count of every word of the corpus decides which.
LEXICON_WORDS = 65_536
#: Words longer than this are merged, not looked up.
LEXICON_BYTES = 40
#: Merged words that a worker remembers before it starts afresh.
CACHE_WORDS = 1_000_000


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


class Vocabulary:
    """Pieces, merges and added tokens of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        symbols = byte_symbols()
        pieces_of = {t: bytes(symbols[c] for c in t) for t in spec["model"]["vocab"]}
        ids = spec["model"]["vocab"]
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        self.added = {t.encode(): i for t, i in added.items()}
        size = 1 + max([*ids.values(), *added.values()])
        self.bytes_of = [b""] * size
        for t, i in ids.items():
            self.bytes_of[i] = pieces_of[t]
        for t, i in added.items():
            self.bytes_of[i] = t.encode()
        self.byte_ids = np.zeros(256, np.int64)
        for c, b in symbols.items():
            self.byte_ids[b] = ids[c]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.merges = np.array([(ids[a], ids[b], ids[a + b]) for a, b in pairs], np.int64)


class Merger:
    """Exact merging of one word: the lowest-ranked adjacent pair first, leftmost of equals."""

    def __init__(self, byte_ids: np.ndarray, merges: np.ndarray):
        self.byte_ids = byte_ids.tolist()
        self.rank = {(a << 32) | b: (r, c) for r, (a, b, c) in enumerate(merges.tolist())}

    def __call__(self, word: bytes) -> list[int]:
        ids = [self.byte_ids[b] for b in word]
        return self._short(ids) if len(ids) <= 48 else self._long(ids)

    def _short(self, ids: list[int]) -> list[int]:
        get = self.rank.get
        while len(ids) > 1:
            best = None
            for x, y in zip(ids, ids[1:]):
                found = get((x << 32) | y)
                if found is not None and (best is None or found[0] < best[0]):
                    best, a, b = found, x, y
            if best is None:
                break
            out, k, n = [], 0, len(ids)
            while k < n:
                if ids[k] == a and k + 1 < n and ids[k + 1] == b:
                    out.append(best[1])
                    k += 2
                else:
                    out.append(ids[k])
                    k += 1
            ids = out
        return ids

    def _long(self, ids: list[int]) -> list[int]:
        """The same by a queue over a linked list, for words of any length."""
        n = len(ids)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        get, queue = self.rank.get, []
        for k in range(n - 1):
            if (found := get((ids[k] << 32) | ids[k + 1])) is not None:
                queue.append((found[0], k, ids[k], ids[k + 1], found[1]))
        heapq.heapify(queue)
        while queue:
            _, k, a, b, c = heapq.heappop(queue)
            m = right[k]
            if ids[k] != a or m < 0 or ids[m] != b:
                continue
            ids[k], ids[m] = c, -1
            right[k] = right[m]
            if right[k] >= 0:
                left[right[k]] = k
            for x, y in ((left[k], k), (k, right[k])):
                if x >= 0 and y >= 0 and (found := get((ids[x] << 32) | ids[y])) is not None:
                    heapq.heappush(queue, (found[0], x, ids[x], ids[y], found[1]))
        return [x for x in ids if x >= 0]


def compile_lexicon(words: list[bytes], merger: Merger) -> bytes:
    """A block with the minimal automaton of the words and their ids; the arrays lie end to end after a JSON header."""
    words = sorted({w for w in words if 0 < len(w) <= LEXICON_BYTES})
    register: dict[tuple, int] = {}
    edges: list[tuple[tuple[int, int], ...]] = []
    final: list[bool] = []

    def state(node: list) -> int:
        """The number of the registered state equal to this finished node."""
        key = (node[0], tuple(node[1]))
        if key not in register:
            register[key] = len(edges)
            edges.append(key[1])
            final.append(key[0])
        return register[key]

    # A node is [is_final, [(byte, state), ...], byte of the open child]; `path` holds the open nodes of the last word.
    path, last = [[False, []]], b""
    for w in words:
        common = next((i for i, (x, y) in enumerate(zip(w, last)) if x != y), min(len(w), len(last)))
        for k in range(len(last) - 1, common - 1, -1):
            path[k][1].append((last[k], state(path.pop())))
        path += [[False, []] for _ in range(len(w) - common)]
        path[-1][0] = True
        last = w
    for k in range(len(last) - 1, -1, -1):
        path[k][1].append((last[k], state(path.pop())))
    root = state(path[0])
    below = [0] * len(edges)
    for s, out in enumerate(edges):  # children are registered before their parents
        below[s] = final[s] + sum(below[t] for _, t in out)
    size = sum(map(len, edges)) * 2 + 1024
    check, target, skip = np.full(size, -1, np.int32), np.zeros(size, np.int32), np.zeros(size, np.int32)
    base, used, low, hole = np.zeros(len(edges), np.int32), bytearray(size), 0, 256
    for s in sorted(range(len(edges)), key=lambda x: -len(edges[x])):
        if not edges[s]:
            continue
        own = [b for b, _ in edges[s]]
        if len(own) == 1:  # fills the holes that the wider states left
            hole = used.index(0, hole)
            at = hole - own[0]
        else:
            at = low
            while any(used[at + b] for b in own):
                at += 1
            low = max(low, at - 24)
        if at + 512 >= len(used):
            grow = len(used)
            used += bytearray(grow)
            check, target, skip = (np.concatenate([x, np.full(grow, v, np.int32)]) for x, v in ((check, -1), (target, 0), (skip, 0)))
        base[s] = at
        before = int(final[s])
        for b, t in edges[s]:
            used[at + b] = 1
            check[at + b], target[at + b], skip[at + b] = s, t, before
            before += below[t]
    top = int(np.flatnonzero(check >= 0)[-1]) + 257 if len(words) else 512
    pad = lambda x, v: np.concatenate([x[:top], np.full(max(0, top - len(x)), v, np.int32)])
    ids = [merger(w) for w in words]
    counts = np.array([len(x) for x in ids], np.int32)
    parts = {"base": base, "final": np.array(final, np.int32), "check": pad(check, -1), "target": pad(target, 0), "skip": pad(skip, 0), "count": counts, "start": (np.cumsum(counts) - counts).astype(np.int32), "ids": np.array([y for x in ids for y in x], np.int32)}
    head = json.dumps({"root": root, "sizes": {k: len(v) for k, v in parts.items()}}).encode()
    return len(head).to_bytes(8, "little") + head + b"\0" * (-len(head) % 8) + b"".join(v.astype(np.int32).tobytes() for v in parts.values())


class Lexicon:
    """The automaton, memory-mapped from a file without a name that ends with its worker."""

    def __init__(self, block: bytes):
        f = os.memfd_create("lexicon")
        with open(f, "wb", closefd=False) as whole:
            whole.write(block)
        self.map = mmap.mmap(f, 0, access=mmap.ACCESS_READ)
        os.close(f)  # the map stays
        n = int.from_bytes(self.map[:8], "little")
        head = json.loads(self.map[8 : 8 + n])
        at = 8 + n + (-n % 8)
        self.root = head["root"]
        for k, size in head["sizes"].items():
            setattr(self, k, np.frombuffer(self.map, np.int32, size, at))
            at += 4 * size

    def find(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The number of each word data[start:end], or -1."""
        out = np.full(len(start), -1, np.int64)
        if not len(self.count):
            return out
        live = np.flatnonzero(end - start <= LEXICON_BYTES)
        at, stop = start[live], end[live]
        state, number = np.full(len(live), self.root, np.int32), np.zeros(len(live), np.int32)
        while len(live):
            slot = self.base[state] + data[at]
            ok = self.check[slot] == state
            number += self.skip[slot]
            state = self.target[slot]
            at = at + 1
            over = at >= stop
            done = ok & over & (self.final[state] == 1)
            out[live[done]] = number[done]
            go = np.flatnonzero(ok & ~over)
            if len(go) < len(live):
                live, at, stop, state, number = live[go], at[go], stop[go], state[go], number[go]
        return out


_OTHER, _LETTER, _NUMBER, _SPACE = 0, 1, 2, 3
_kinds: list[np.ndarray] = []


def kinds() -> np.ndarray:
    """The class of each code point."""
    if not _kinds:
        import regex

        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        table = np.zeros(0x110000, np.uint8)
        for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\p{White_Space}+")):
            for m in regex.finditer(pattern, every):
                a, b = ord(every[m.start()]), ord(every[m.end() - 1])
                table[a : b + 1] = kind
        _kinds.append(table)
    return _kinds[0]


def split_words(data: np.ndarray, offsets: np.ndarray, added: dict[bytes, int]):
    """Byte starts and ends of the words of each row, and a list of (word, id) for added tokens.

    Rows are laid end to end; no word crosses a row or an added token.
    """
    lo, hi = int(offsets[0]), int(offsets[-1])
    raw = data[lo:hi].tobytes()
    code = np.frombuffer(raw.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    n = len(code)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, []
    place = np.zeros(n + 1, np.int64)
    np.cumsum(1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF), out=place[1:])
    kind = kinds()[code]
    cut = np.zeros(n + 1, bool)
    cut[np.searchsorted(place, offsets - lo)] = True
    special = []
    for text, i in added.items():
        at = raw.find(text)
        while at >= 0:
            k = int(np.searchsorted(offsets - lo, at, side="right"))
            if at + len(text) <= offsets[k] - lo:
                a, b = (int(np.searchsorted(place, x)) for x in (at, at + len(text)))
                special.append((a, b, i))
                cut[a] = cut[b] = True
                at = raw.find(text, at + len(text))
            else:
                at = raw.find(text, at + 1)
    cut[0] = cut[n] = True
    run = np.ones(n + 1, bool)
    run[1:n] = kind[1:] != kind[:-1]
    run |= cut
    space = kind == _SPACE
    begin = run[:n].copy()
    # a space before a word belongs to it; other white space before a word stands alone
    joined = np.zeros(n, bool)
    joined[1:] = begin[1:] & ~space[1:] & (code[:-1] == 32) & ~cut[1:n]
    begin &= ~joined
    before = np.flatnonzero(space[:-1] & ~space[1:] & ~cut[1:n]) if n > 1 else np.zeros(0, np.int64)
    begin[before] = True
    # 's 't 'm 'd 're 've 'll, where the apostrophe begins a word
    quote = np.flatnonzero((code[: n - 1] == 39) & begin[: n - 1] & (kind[1:] == _LETTER) & ~cut[1:n]) if n > 1 else before
    if len(quote):
        one = np.isin(code[quote + 1], [115, 116, 109, 100])
        third = np.minimum(quote + 2, n - 1)
        same = (quote + 2 < n) & ~cut[np.minimum(quote + 2, n)]
        x, y = code[quote + 1], code[third]
        two = same & (((x == 114) & (y == 101)) | ((x == 118) & (y == 101)) | ((x == 108) & (y == 108))) & ~one
        for found, width in ((one, 2), (two, 3)):
            q = quote[found]
            begin[q + 1] = False
            nxt = q + width
            nxt = nxt[(nxt < n)]
            nxt = nxt[(kind[nxt] == _LETTER) & ~cut[nxt]]
            begin[nxt] = True
    for a, b, _ in special:
        begin[a:b] = False
        begin[a] = True
    s = np.flatnonzero(begin)
    marks = [(int(np.searchsorted(s, a)), i) for a, _, i in special]
    starts = place[s] + lo
    ends = np.concatenate([starts[1:], [hi]])
    return starts, ends, marks


class Encoder:
    """Per worker: the mapped lexicon, the merger and a cache of merged words."""

    def __init__(self, block: bytes, byte_ids: np.ndarray, merges: np.ndarray, added: dict[bytes, int]):
        self.lexicon, self.merger, self.added = Lexicon(block), Merger(byte_ids, merges), added
        self.forget()

    def forget(self) -> None:
        self.seen: dict[bytes, int] = {}
        self.more, self.more_start, self.more_count = array("i"), array("q"), array("i")

    def _merged(self, word: bytes) -> int:
        k = len(self.more_start)
        ids = [self.added[word[1:]]] if word[:1] == b"\0" and word[1:] in self.added else self.merger(word)
        self.more_start.append(len(self.more))
        self.more_count.append(len(ids))
        self.more.extend(ids)
        self.seen[word] = k
        return k

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows end to end, and n+1 bounds."""
        if len(self.seen) > CACHE_WORDS:
            self.forget()
        s, e, marks = split_words(data, offsets, self.added)
        lex = self.lexicon
        number = lex.find(data, s, e)
        unseen = np.flatnonzero(number < 0)
        lo = int(offsets[0])
        raw = data[lo : int(offsets[-1])].tobytes()
        get, merged = self.seen.get, self._merged
        places = np.fromiter((k if (k := get(w)) is not None else merged(w) for w in (raw[a:b] for a, b in zip((s[unseen] - lo).tolist(), (e[unseen] - lo).tolist()))), np.int64, len(unseen))
        base = len(lex.ids)
        count, start = np.zeros(len(s), np.int64), np.zeros(len(s), np.int64)
        known = np.flatnonzero(number >= 0)
        count[known], start[known] = lex.count[number[known]], lex.start[number[known]]
        if len(unseen):
            count[unseen] = np.frombuffer(self.more_count, np.int32)[places]
            start[unseen] = np.frombuffer(self.more_start, np.int64)[places] + base
        table = np.concatenate([lex.ids, np.frombuffer(self.more, np.int32)]) if len(unseen) else lex.ids
        if marks:
            own = np.array([i for _, i in marks], np.int32)
            where = np.array([w for w, _ in marks])
            start[where], count[where] = len(table) + np.arange(len(own)), 1
            table = np.concatenate([table, own])
        ids = table[ragged(start, count)].astype(np.uint32)
        ends = np.concatenate([[0], np.cumsum(count)])
        return ids, ends[np.searchsorted(s, offsets)]


def word_counts(docs: DataFrame, text_col: str, added: dict[bytes, int]) -> DataFrame:
    """How often each word of the corpus occurs; each task counts its own words before the shuffle."""

    def run(batches):
        for batch in batches:
            data, off = utf8(batch.column(0))
            total: dict[bytes, int] = {}
            for i, j in pieces(off):
                s, e, _ = split_words(data, off[i : j + 1], added)
                lo = int(off[i])
                raw = data[lo : int(off[j])].tobytes()
                small = e - s <= LEXICON_BYTES
                get = total.get
                for a, b in zip((s[small] - lo).tolist(), (e[small] - lo).tolist()):
                    w = raw[a:b]
                    total[w] = get(w, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.binary()), pa.array(total.values(), pa.int64())], names=["word", "n"])

    each = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "word binary, n long")
    return each.groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(docs: DataFrame, text_col: str, added: dict[bytes, int], most: int = LEXICON_WORDS) -> list[bytes]:
    """The most frequent words, `most` at most; a bounded list, so it may go to the driver.

    Counts are put into eight classes for each doubling; the lowest class that still fits
    decides, so that no task sends more than its own part of the list.
    """
    counts = stored(word_counts(docs, text_col, added).where("n > 1").withColumn("grade", F.floor(8 * F.log2("n")).cast("int")))
    total, least = 0, None
    for grade, n in sorted(((r[0], r[1]) for r in counts.groupBy("grade").count().collect()), reverse=True):  # 512 classes at most
        total += n
        if total > most:
            break
        least = grade
    if least is None:
        return []
    return [bytes(r[0]) for r in counts.where(F.col("grade") >= least).select("word").collect()]


_encoders: dict[str, Encoder] = {}


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", lexicon_words: int = LEXICON_WORDS) -> DataFrame:
    """(id, ids array<int>, decoded string): the ids of each whole text and the text they decode to."""
    shared = _shared(docs, tokenizer, text_col, lexicon_words)

    def rows(ids, data, off):
        got, ends, decoded = _both(shared, data, off)
        lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(got.astype(np.int32)))
        return [ids, lists, pa.array([d.decode("utf-8", "replace") for d in decoded])]

    kind = docs.schema[id_col].dataType.simpleString()
    return map_text(docs, id_col, text_col, f"{id_col} {kind}, ids array<int>, decoded string", rows)


def digests(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", lexicon_words: int = LEXICON_WORDS) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of each text, hashed where the ids are made."""
    shared = _shared(docs, tokenizer, text_col, lexicon_words)

    def rows(ids, data, off):
        got, ends, decoded = _both(shared, data, off)
        little = got.astype("<u4")
        sha = lambda b: hashlib.sha256(b).hexdigest()
        return [ids, np.diff(ends), [sha(little[a:b].tobytes()) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())], [sha(_valid(d)) for d in decoded]]

    kind = docs.schema[id_col].dataType.simpleString()
    return map_text(docs, id_col, text_col, f"{id_col} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string", rows)


def _valid(b: bytes) -> bytes:
    with contextlib.suppress(UnicodeDecodeError):
        b.decode("utf-8")
        return b
    return b.decode("utf-8", "replace").encode()


def _shared(docs: DataFrame, tokenizer: str, text_col: str, lexicon_words: int):
    """What the workers need, as one broadcast: its size is bounded by the vocabulary and the lexicon."""
    v = Vocabulary(tokenizer)
    block = compile_lexicon(frequent_words(docs, text_col, v.added, lexicon_words), Merger(v.byte_ids, v.merges))
    sizes = np.array([len(b) for b in v.bytes_of], np.int64)
    flat = np.frombuffer(b"".join(v.bytes_of), np.uint8)
    key = hashlib.sha256(block + v.byte_ids.tobytes() + v.merges.tobytes() + flat.tobytes() + repr(sorted(v.added.items())).encode()).hexdigest()
    return docs.sparkSession.sparkContext.broadcast((key, block, v.byte_ids, v.merges, v.added, sizes, np.cumsum(sizes) - sizes, flat))


def _both(shared, data: np.ndarray, off: np.ndarray):
    key, block, byte_ids, merges, added, sizes, starts, flat = shared.value
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(block, byte_ids, merges, added)
    ids, ends = _encoders[key](data, off)
    lengths = sizes[ids]
    out = flat[ragged(starts[ids], lengths)]
    at = np.concatenate([[0], np.cumsum(lengths)])[ends]
    raw = out.tobytes()
    return ids, ends, [raw[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]


def decode(tokens: DataFrame, tokenizer: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, decoded string) of lists of ids; ids outside the vocabulary decode to nothing, as a null list does."""
    v = Vocabulary(tokenizer)
    table = tokens.sparkSession.sparkContext.broadcast(v.bytes_of)

    def run(batches):
        for batch in batches:
            known = table.value
            texts = [b"".join(known[i] for i in (x or ()) if i is not None and 0 <= i < len(known)).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "decoded"])

    kind = tokens.schema[id_col].dataType.simpleString()
    return tokens.select(F.col(id_col), F.col(ids_col)).mapInArrow(run, f"{id_col} {kind}, decoded string")
