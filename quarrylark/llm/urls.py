"""URL filter: a sorted digest array in a memory-mapped file.

The rules' strings (host and path joined) are digested by 64-bit xxhash; the
sorted digests, the strings' places and the strings make one index file in
the shared folder. Spark hands it to every executor, which maps it into
memory. A URL is probed with each suffix of its host that starts at a label,
joined with each prefix of its path whose length some rule has; all probes
of a batch are searched at once by vectorised binary search, and the stored
string confirms a hit. The longest rule wins.

Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased;
path: from there up to `?`, `#` or the end. A null URL, or one without
`://`, has an empty host and path and no rule. Without a rule the verdict is
`default`. Rules with equal strings: the last one given counts. Rows are
judged one by one; other columns are ignored.
"""

from __future__ import annotations

import json
import mmap
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylark.llm.shared import share_file

#: (verdict, host, path)
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def build_index(rules: list[tuple[str, str, str]]) -> bytes:
    """The index file's bytes: a head, digests, places, strings."""
    stored = {(h.lower() + p).encode(): (v, len(h.encode())) for v, h, p in rules}
    ranked = sorted((xxhash.xxh64_intdigest(k), k) for k in stored)
    ends = np.cumsum([0, *(len(k) for _, k in ranked)]).astype(np.uint64)
    head = json.dumps({"n": len(ranked), "lengths": sorted({len(k) - stored[k][1] for _, k in ranked})}).encode()
    hosts = np.array([stored[k][1] for _, k in ranked], np.uint32)
    block = np.array([stored[k][0] == "block" for _, k in ranked], np.uint8)
    head += b" " * (-(len(head) + 8) % 8)
    return len(head).to_bytes(8, "little") + head + np.array([d for d, _ in ranked], np.uint64).tobytes() + ends.tobytes() + hosts.tobytes() + block.tobytes() + b"".join(k for _, k in ranked)


class DigestIndex:
    """The mapped file; find() gives the rule of each probe, or -1."""

    def __init__(self, buffer):
        size = int.from_bytes(buffer[:8], "little")
        head = json.loads(bytes(buffer[8 : 8 + size]))
        n, at = head["n"], 8 + size
        self.lengths = head["lengths"]
        self.digests = np.frombuffer(buffer, np.uint64, n, at)
        self.ends = np.frombuffer(buffer, np.uint64, n + 1, at := at + 8 * n)
        self.hosts = np.frombuffer(buffer, np.uint32, n, at := at + 8 * (n + 1))
        self.block = np.frombuffer(buffer, np.uint8, n, at := at + 4 * n)
        self.strings, self.buffer = at + n, buffer

    @classmethod
    def open(cls, path: str) -> DigestIndex:
        with open(path, "rb") as f:
            return cls(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    def string(self, k: int) -> bytes:
        return bytes(self.buffer[self.strings + int(self.ends[k]) : self.strings + int(self.ends[k + 1])])

    def find(self, probes: list[bytes], host_lengths: list[int]) -> np.ndarray:
        out = np.full(len(probes), -1)
        if not len(self.digests) or not probes:
            return out
        digest = np.array([xxhash.xxh64_intdigest(p) for p in probes], np.uint64)
        at = np.searchsorted(self.digests, digest)
        for i in np.flatnonzero(self.digests[np.minimum(at, len(self.digests) - 1)] == digest).tolist():
            k = int(at[i])
            while k < len(self.digests) and self.digests[k] == digest[i]:  # equal digests of other strings
                if self.hosts[k] == host_lengths[i] and self.string(k) == probes[i]:
                    out[i] = k
                    break
                k += 1
        return out


def split_url(url: str | None) -> tuple[str, str]:
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    host, tail = rest[:end], rest[end:]
    stop = min((i for i in map(tail.find, "?#") if i >= 0), default=len(tail))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), tail[:stop]


def judge(index: DigestIndex, urls: list[str | None], default: str) -> tuple[list, list, list, list]:
    hosts, paths, probes, lengths, owner = [], [], [], [], []
    for i, url in enumerate(urls):
        host, path = split_url(url)
        hosts.append(host)
        paths.append(path)
        if not host:
            continue
        h, p = host.encode("utf-8", "surrogatepass"), path.encode("utf-8", "surrogatepass")
        starts = [0, *(k + 1 for k, c in enumerate(h) if c == 46)]
        for n in index.lengths:
            if n <= len(p):
                for s in starts:
                    probes.append(h[s:] + p[:n])
                    lengths.append(len(h) - s)
                    owner.append(i)
    rule, verdict, best = [None] * len(urls), [default] * len(urls), [-1] * len(urls)
    found = index.find(probes, lengths)
    for j in np.flatnonzero(found >= 0).tolist():
        i, k = owner[j], int(found[j])
        if len(probes[j]) > best[i]:
            best[i], rule[i], verdict[i] = len(probes[j]), probes[j].decode("utf-8", "surrogatepass"), "block" if index.block[k] else "allow"
    return hosts, paths, rule, verdict


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, default: str = "allow", key: str = "page_id") -> DataFrame:
    """The key, host, path, rule and verdict of each row's url."""
    name = f"url-index-{uuid.uuid4().hex}.bin"
    share_file(pages.sparkSession, name, build_index(rules))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = DigestIndex.open(SparkFiles.get(name))
        for batch in batches:
            parts = judge(index, batch.column(1).to_pylist(), default)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(p, pa.string()) for p in parts)], names=[key, "host", "path", "rule", "verdict"])

    pages = pages.select(key, F.col("url").cast("string").alias("url"))
    return pages.mapInArrow(scan, f"`{key}` {pages.schema[key].dataType.simpleString()}, host string, path string, rule string, verdict string")


def op6(spark, sf_dir: str) -> DataFrame:
    from quarrylark.llm.shared import table

    return filter_urls(table(spark, sf_dir, "pages"))


_RULE = "(%(host)r = host OR ends_with(host, '.' || %(host)r)) AND starts_with(path, %(path)r)"
_FITS = ", ".join(f"CASE WHEN {_RULE % {'host': h, 'path': p}} THEN {{'rule': {h + p!r}, 'verdict': {v!r}}} END" for v, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2])))
SQL = f"""
WITH a AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS h FROM a),
c AS (SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path FROM b),
d AS (SELECT *, coalesce({_FITS}) AS fit FROM c)
SELECT page_id, host, path, fit.rule AS rule, coalesce(fit.verdict, 'allow') AS verdict FROM d
"""
