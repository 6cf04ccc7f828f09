"""Byte-level BPE by content-defined chunks.

Texts are cut where a rolling hash of the last bytes says so, so equal passages give equal chunks in
whatever document they stand. A Python worker encodes each chunk once and keeps it, across tasks, in a
bounded memory. The joins are then repaired: between the last place in one chunk and the first place in the next where
the pieces of the tokenizer must break whatever surrounds them, the text is encoded again, over more
chunks if need be, so that the ids are those of the whole text.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
from collections import OrderedDict
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from .common import map_texts, tune

#: A chunk ends on average after 2^BITS bytes, at least MIN_CHUNK and at most MAX_CHUNK characters.
BITS, WINDOW = 9, 16
MIN_CHUNK, MAX_CHUNK = 128, 8192
#: Bytes of chunk text that a worker remembers.
CACHE_BYTES = 48 << 20
#: A break between pieces on which every context agrees: white space after a sign that is none. No
#: piece holds white space behind another sign, and no special token holds white space.
BREAK = re.compile(r"(?<=\S)(?=[ \t\r\n])")
ADDED = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def cut_points(text: str) -> list[int]:
    """Ends of the chunks of a text, the last one its length. A cut depends on the WINDOW code points
    before it and on the distance to the cut before."""
    n = len(text)
    if n <= MIN_CHUNK:
        return [n] if n else []
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    mixed = (codes + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    rolling = np.zeros(n, np.uint64)  # sum of shifted codes: equal windows give equal sums
    for i in range(WINDOW):
        rolling[i:] += mixed[: n - i] << np.uint64(i)
    wanted = np.flatnonzero((rolling * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - BITS) == 0) + 1
    cuts, last = [], 0
    for p in wanted.tolist() + [n]:
        while p - last > MAX_CHUNK:
            last += MAX_CHUNK
            cuts.append(last)
        if p - last >= MIN_CHUNK or p == n > last:
            cuts.append(p)
            last = p
    return cuts


class ByteBpe:
    """The vocabulary of a byte-level tokenizer file, with its special tokens, and its byte table."""

    def __init__(self, json_path: str, ranks_path: str, pattern: str):
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        with open(json_path) as f:
            added = json.load(f)["added_tokens"]
        self.special = {t["content"]: t["id"] for t in added}
        if any(re.search(r"\s", t) for t in self.special):
            raise ValueError("a special token with white space could stand across a break")
        self.core = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens=self.special)
        self.names = [str(i) for i in range(max([*ranks.values(), *self.special.values()]) + 1)]

    def encode(self, text: str) -> list[int]:
        return self.core.encode(text, allowed_special="all")

    def decode(self, ids: list[int]) -> str:
        return self.core.decode(ids)


class ChunkEncoder:
    """Encodes texts by remembered chunks; the memory drops the chunks not used for longest."""

    def __init__(self, bpe: ByteBpe, cache_bytes: int = CACHE_BYTES):
        self.bpe, self.limit, self.held = bpe, cache_bytes, 0
        self.cache: OrderedDict[str, tuple] = OrderedDict()
        self.hits = self.misses = 0

    def chunk(self, text: str) -> tuple:
        """(head, ids of the body, tail): head up to the first break of the chunk, tail from its last
        break; (text, None, "") if it has fewer than two breaks."""
        got = self.cache.get(text)
        if got is not None:
            self.hits += 1
            self.cache.move_to_end(text)
            return got
        self.misses += 1
        first = BREAK.search(text)
        last = max(text.rfind(" "), text.rfind("\n"))
        while last > 0 and text[last - 1].isspace():
            last = max(text.rfind(" ", 0, last), text.rfind("\n", 0, last))
        if first is None or last <= first.start():
            got = (text, None, "")
        else:
            body = self.bpe.encode(text[first.start() : last])
            got = (text[: first.start()], np.array(body, np.uint32), text[last:])
        self.cache[text] = got
        self.held += 16 * len(text)
        while self.held > self.limit and len(self.cache) > 1:
            old, _ = self.cache.popitem(last=False)
            self.held -= 16 * len(old)
        return got

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        open_text, at = "", 0  # text of the join that is not yet closed
        for end in cut_points(text):
            head, body, tail = self.chunk(text[at:end])
            at = end
            open_text += head
            if body is None:
                continue  # no place to agree on: the join runs on into the next chunk
            if open_text:
                ids += self.bpe.encode(open_text)
            ids += body.tolist()
            open_text = tail
        if open_text:
            ids += self.bpe.encode(open_text)
        return ids


@lru_cache(1)
def worker_encoder(files: tuple[str, str] | None, pattern: str | None) -> ChunkEncoder:
    """The encoder of a Python worker: tasks that run one after the other in it share its chunks."""
    import public_tokenizers

    names = files or (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return ChunkEncoder(ByteBpe(*names, pattern or public_tokenizers.PATTERN))


def encode_documents(docs: DataFrame, keep: list[str], with_ids: bool = False, files: tuple[str, str] | None = None, pattern: str | None = None) -> DataFrame:
    """Add n_tokens, ids_sha256 and decoded_sha256 (and ids) to each document, in one narrow pass.

    ``files``: places of the tokenizer (.json) and of its ranks (.tiktoken), by default the public
    ``byte_bpe_50k``. Null and empty texts have no tokens. A worker holds one batch of texts and
    ``CACHE_BYTES`` of chunks; a lost task is encoded again from its input. Rows that repeat are each encoded;
    an empty table gives an empty table; a kept column named like an added one gives way to it.
    """
    tune(docs.sparkSession)

    def make():
        encoder = worker_encoder(files, pattern)
        bpe = encoder.bpe
        name = bpe.names.__getitem__

        def run(texts: list) -> list:
            out: list = [[], [], [], []]
            for t in texts:
                ids = encoder.encode(t or "")
                out[0].append(len(ids))
                out[1].append(hashlib.sha256(",".join(map(name, ids)).encode()).hexdigest())
                out[2].append(hashlib.sha256(bpe.decode(ids).encode("utf-8")).hexdigest())
                if with_ids:
                    out[3].append(np.array(ids, np.int32))
            return out if with_ids else out[:3]

        return run

    return map_texts(docs, keep, "text", make, ADDED + ", ids array<int>" * with_ids)


def decode_documents(encoded: DataFrame, keep: list[str], ids: str = "ids") -> DataFrame:
    """Columns ``keep`` and decoded, the texts of ``ids``: null ids give a null text, no ids the empty one. Equal rows get
    equal rows; an empty table gives an empty table; a kept column named decoded gives way."""
    tune(encoded.sparkSession)

    def make():
        bpe = worker_encoder(None, None).bpe
        return lambda rows: [[None if r is None else bpe.decode(list(r)) for r in rows]]

    return map_texts(encoded, keep, ids, make, "decoded string")
