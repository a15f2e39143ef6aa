"""The operators' results worked out plainly, in memory."""

import collections
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import xxhash
from tokenizers import Tokenizer

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fingerprint(text):
    words = WORD.findall((text or "").translate(LOW))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints):
    """The smallest reachable id by id; ``prints`` by id."""
    parent = {i: i for i in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(prints)
    values = np.array([prints[i] for i in ids], np.uint64)
    for k, i in enumerate(ids):
        for other in np.flatnonzero(np.bitwise_count(values[k + 1 :] ^ values[k]) <= 2):
            a, b = find(i), find(ids[k + 1 + other])
            if a != b:
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def luhn(digits):
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def _digits(match):
    return re.sub("[^0-9]", "", match)


PATTERNS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(_digits(m)) <= 19 and luhn(_digits(m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(_digits(m)) <= 15),
)


def base_spans(text):
    found = [
        (m.start(), kind, m.end())
        for kind, (_, pattern, test) in enumerate(PATTERNS)
        for m in re.finditer(pattern, text or "")
        if test(m.group())
    ]
    return sorted(found)


def spans_digest(spans):
    joined = ",".join(f"{PATTERNS[k][0]}:{a}:{b}" for a, k, b in spans)
    return hashlib.sha256(joined.encode()).hexdigest()


_tokenizer = None


def pieces(text, capacity=2048):
    """(piece, start, length, ids_crc32) of a document."""
    global _tokenizer
    _tokenizer = _tokenizer or Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = np.array([*_tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
    return [
        (k, start, len(ids[start : start + capacity]), zlib.crc32(ids[start : start + capacity].tobytes()))
        for k, start in enumerate(range(0, len(ids), capacity))
    ]


def check_packing(rows, texts, capacity=2048):
    """Every piece is there, and every sequence is gapless and within the capacity."""
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
        by_sequence[r.sequence_id].append((r.offset, r.length))
    assert set(by_doc) == set(texts)
    for i, text in texts.items():
        assert sorted(by_doc[i]) == pieces(text, capacity), i
    for held in by_sequence.values():
        end = 0
        for offset, length in sorted(held):
            assert offset == end
            end += length
        assert end <= capacity
    return len(by_sequence)


def jump(key, shards):
    shard, place = -1, 0
    while place < shards:
        shard = place
        key = (key * 2862933555777941757 + 1) % 2**64
        place = int((shard + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return shard
