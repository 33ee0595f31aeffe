"""Token-ID output: raw id payloads in ordered shards, each with a minimal perfect hash index.

``write_token_shards`` deals documents into shards by ranges of their id, encodes each shard's texts in ascending id
order and streams the ids to ``shard-NNNNNN-<attempt>.ids`` (raw little-endian integers, nothing else). Beside it,
``.idx`` holds a minimal perfect hash of the shard's keys: a header, a displacement for each bucket, and for each slot a
64-bit fingerprint, the offset and the number of ids, all of fixed width. The manifest names each shard's range of ids.

``lookup`` finds the shard by its range, reads the header, one displacement and one slot of its index, compares the
fingerprint and reads one range of the payload: four small reads of two files, whatever their size, and no key is stored
in the index. A key that is not there passes the fingerprint once in 2^64. For scans, ``.keys`` lists the ids in order.

A task writes files of its own name and returns a manifest row; the manifest is what succeeded, so a lost or repeated
task leaves at most files that nothing names. Memory is bounded by a slice of texts and the keys of one shard; the number
of shards is a parameter, by size in the query.

Cases: null and empty texts encode to the end id alone; null ids come first and are keyed by a fixed value; rows that
repeat an id are keyed by their occurrence (ordered by text; where one id fills several shards, by shard, then text); an
empty table gives an empty manifest; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .tokens import CACHE, encoder

_U = np.uint64
_MANIFEST = "shard int, payload string, index string, keys string, width int, first long, last long, n_docs long, n_ids long"
#: Of the index: two numbers of the header, a displacement, and a slot (fingerprint, offset, length).
_HEADER, _DISPLACEMENT, _SLOT = np.dtype("<u8"), np.dtype("<i4"), np.dtype([("fingerprint", "<u8"), ("offset", "<u8"), ("length", "<u8")])
#: Ids that a scan reads at once.
BLOCK = 1 << 20


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64: a bijection of 64-bit values."""
    x = x.astype(_U)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def hashed_keys(keys: np.ndarray, occurrence: np.ndarray) -> np.ndarray:
    return _mix(keys.astype(np.int64).view(_U) + _U(0x9E3779B97F4A7C15) * (occurrence.astype(_U) + _U(1)))


def _slots(h: np.ndarray, displacement: np.ndarray, n: int) -> np.ndarray:
    return (_mix(h + _U(0xD6E8FEB86659FD93) * (displacement.astype(_U) + _U(1))) % _U(n)).astype(np.int64)


def build_mph(h: np.ndarray, per_bucket: int = 4) -> np.ndarray:
    """Displacements of a minimal perfect hash of distinct 64-bit keys onto 0..n-1.

    Buckets are placed from the largest; a bucket takes the first displacement that sends its keys to free, distinct
    slots. Buckets of one key name a free slot outright, as -1 - slot.
    """
    n = len(h)
    buckets = max(1, -(-n // per_bucket))
    of = (h % _U(buckets)).astype(np.int64)
    order = np.argsort(of, kind="stable")
    sizes = np.bincount(of, minlength=buckets)
    ends = np.cumsum(sizes)
    out = np.zeros(buckets, np.int64)
    free = np.ones(n, bool)
    for b in np.argsort(-sizes, kind="stable"):
        k = sizes[b]
        if k < 2:
            break
        own, at = h[order[ends[b] - k : ends[b]]], 0
        if len(np.unique(own)) < k:
            raise ValueError("keys of a minimal perfect hash must be distinct")
        while True:
            tries = np.arange(at, at + 64)
            slots = _slots(own[None, :], tries[:, None], n)
            ordered = np.sort(slots, axis=1)
            good = free[slots].all(axis=1) & (ordered[:, 1:] != ordered[:, :-1]).all(axis=1)
            if good.any():
                i = int(np.argmax(good))
                free[slots[i]] = False
                out[b] = tries[i]
                break
            at += 64
    out[sizes == 1] = -1 - np.flatnonzero(free)[: int((sizes == 1).sum())]
    return out


def find_slots(h: np.ndarray, displacements: np.ndarray, n: int) -> np.ndarray:
    d = displacements[(h % _U(len(displacements))).astype(np.int64)]
    return np.where(d < 0, -1 - d, _slots(h, np.maximum(d, 0), n))


def fingerprints(h: np.ndarray) -> np.ndarray:
    """A second hash of a key, beside the one that places it."""
    return _mix(h ^ _U(0xA0761D6478BD642F))


class _Shard:
    """A shard while it is written."""

    def __init__(self, root: str, number: int, width: int):
        self.store, path = common.open_store(root)
        self.store.create_dir(path)
        self.stem, self.number, self.width = f"{path}/shard-{number:06d}-{uuid.uuid4().hex[:12]}", number, width
        self.uri = f"{root}/{self.stem.rpartition('/')[2]}"
        self.out = self.store.open_output_stream(f"{self.stem}.ids")
        self.keys: list[int] = []
        self.counts: list[int] = []

    def add(self, keys: list[int], ids: list[np.ndarray], end_id: int) -> None:
        kind, end = f"<u{self.width}", np.array([end_id])
        self.out.write(np.concatenate([x for i in ids for x in (i, end)]).astype(kind).tobytes())
        self.keys += keys
        self.counts += [len(i) + 1 for i in ids]

    def close(self) -> dict[str, list]:
        self.out.close()
        keys, counts = np.array(self.keys, np.int64), np.array(self.counts, np.int64)
        n = len(keys)
        h = hashed_keys(keys, occurrences(keys))
        displacements = build_mph(h)
        table = np.zeros(n, _SLOT)
        placed = find_slots(h, displacements, n)
        table["fingerprint"][placed], table["offset"][placed], table["length"][placed] = fingerprints(h), np.cumsum(counts) - counts, counts
        for kind, held in ((".idx", np.array([n, len(displacements)], _HEADER).tobytes() + displacements.astype(_DISPLACEMENT).tobytes() + table.tobytes()), (".keys", keys.astype("<i8").tobytes())):
            with self.store.open_output_stream(f"{self.stem}{kind}") as f:
                f.write(held)
        return {"shard": [self.number], "payload": [f"{self.uri}.ids"], "index": [f"{self.uri}.idx"], "keys": [f"{self.uri}.keys"], "width": [self.width], "first": [int(keys[0])], "last": [int(keys[-1])], "n_docs": [n], "n_ids": [int(counts.sum())]}


def occurrences(keys: np.ndarray) -> np.ndarray:
    """How many equal keys come before each; keys ascend, so equal ones are neighbours."""
    first = np.r_[True, keys[1:] != keys[:-1]] if len(keys) else np.zeros(0, bool)
    at = np.arange(len(keys))
    return at - np.maximum.accumulate(np.where(first, at, 0)) if len(keys) else at


def write_token_shards(docs: DataFrame, root: str, tokenizer: str, end_id: int, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the shards below root and return their manifest, a row for each shard (also kept as root/manifest)."""
    spark = docs.sparkSession
    data = docs.select(F.col(id_col).cast("long").alias("k"), common.text_column(text_col).alias("t"))
    splits = common.range_splits(data, "k", shards)
    dealt = data.withColumn("b", common.range_bucket("k", splits, F.xxhash64("t"))).repartitionById(len(splits) + 1, F.col("b")).sortWithinPartitions("b", F.col("k").asc_nulls_first(), "t")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, encode, width = None, encoder(tokenizer), 2 if max(end_id, encoder(tokenizer).tokenizer.get_vocab_size()) < 65536 else 4
        for batch in common.in_slices(batches, 256):
            ids, keys = encode.ids(batch.column("t").to_pylist()), batch.column("k").fill_null(common.NULL_KEY).to_pylist()
            buckets = batch.column("b").to_numpy()
            for part in np.split(np.arange(len(keys)), np.flatnonzero(np.diff(buckets)) + 1):
                if shard is None or shard.number != buckets[part[0]]:
                    if shard:
                        yield pa.RecordBatch.from_pydict(shard.close(), _manifest_schema())
                    shard = _Shard(root, int(buckets[part[0]]), width)
                shard.add([keys[i] for i in part], [ids[i] for i in part], end_id)
        if shard:
            yield pa.RecordBatch.from_pydict(shard.close(), _manifest_schema())

    common.map_batches(dealt, write, _MANIFEST, CACHE).write.parquet(f"{root}/manifest")
    return spark.read.schema(_MANIFEST).parquet(f"{root}/manifest")


def _manifest_schema() -> pa.Schema:
    kinds = {"int": pa.int32(), "string": pa.string(), "long": pa.int64()}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in _MANIFEST.split(", ")])


class ShardReader:
    """Keyed access to one shard's files, by reads of fixed size."""

    def __init__(self, payload: str, index: str, width: int):
        (store, path), (other, ids) = common.open_store(index), common.open_store(payload)
        self.index, self.payload, self.width = store.open_input_file(path), other.open_input_file(ids), width
        self.n, self.buckets = (int(x) for x in np.frombuffer(self.index.read_at(2 * _HEADER.itemsize, 0), _HEADER))

    def _read(self, kind: np.dtype, at: int, many: int = 1) -> np.ndarray:
        return np.frombuffer(self.index.read_at(many * kind.itemsize, at), kind)

    def slot(self, key: int, occurrence: int) -> np.void | None:
        """The slot of a key, or None if its fingerprint is another's."""
        if not self.n:
            return None
        h = hashed_keys(np.array([key], np.int64), np.array([occurrence]))
        start = 2 * _HEADER.itemsize
        displacement = self._read(_DISPLACEMENT, start + int(h[0] % _U(self.buckets)) * _DISPLACEMENT.itemsize).astype(np.int64)
        at = int(np.where(displacement < 0, -1 - displacement, _slots(h, np.maximum(displacement, 0), self.n))[0])
        found = self._read(_SLOT, start + self.buckets * _DISPLACEMENT.itemsize + at * _SLOT.itemsize)[0]
        return found if found["fingerprint"] == fingerprints(h)[0] else None

    def locate(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and lengths of all of a shard's keys, by the whole index."""
        h = hashed_keys(keys, occurrences(keys))
        start = 2 * _HEADER.itemsize
        displacements = self._read(_DISPLACEMENT, start, self.buckets).astype(np.int64)
        found = self._read(_SLOT, start + self.buckets * _DISPLACEMENT.itemsize, self.n)[find_slots(h, displacements, self.n)]
        if not (found["fingerprint"] == fingerprints(h)).all():
            raise ValueError("the index of a shard is damaged")
        return found["offset"].astype(np.int64), found["length"].astype(np.int64)

    def ids(self, offset: int, length: int) -> np.ndarray:
        return np.frombuffer(self.payload.read_at(int(length) * self.width, int(offset) * self.width), f"<u{self.width}")


def read_token_shards(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """Every document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, and ids if asked.

    A shard's keys are looked up in its index, and its payload is read in large blocks, in order. The driver holds one
    number for each shard, the ids before it.
    """
    totals = manifest.select("shard", "n_ids").orderBy("shard").collect()
    before = dict(zip([r.shard for r in totals], np.cumsum([0, *(r.n_ids for r in totals)]).tolist(), strict=False))
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                shard = ShardReader(r["payload"], r["index"], r["width"])
                store, path = common.open_store(r["keys"])
                with store.open_input_stream(path) as f:
                    keys = np.frombuffer(f.read(), "<i8")
                offset, length = shard.locate(keys)
                at = 0
                while at < len(keys):
                    # documents that fit a block, one at least
                    past = max(at + 1, int(np.searchsorted(offset, offset[at] + BLOCK)))
                    part = slice(at, min(past, at + 4096))
                    end = int(offset[part][-1] + length[part][-1])
                    held = shard.ids(offset[at], end - offset[at])
                    ids = [held[o - offset[at] : o - offset[at] + n] for o, n in zip(offset[part], length[part], strict=True)]
                    columns = [
                        pa.array(keys[part], mask=keys[part] == common.NULL_KEY),
                        pa.array(offset[part] + before[r["shard"]]),
                        pa.array(length[part]),
                        pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()),
                    ]
                    if with_ids:
                        columns.append(pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())))
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])
                    at = part.stop

    return common.map_batches(manifest.repartitionById(max(1, len(totals)), F.col("shard") % max(1, len(totals))), read, schema)


def lookup(manifest: DataFrame, key: int | None, occurrence: int = 0) -> np.ndarray | None:
    """Ids of one document (None if there is none): its shard by the manifest's ranges, then four small reads.

    Occurrences are counted within a shard, then in the next that holds the id.
    """
    k = common.NULL_KEY if key is None else key
    for r in manifest.where((F.col("first") <= k) & (F.col("last") >= k)).orderBy("shard").collect():
        shard = ShardReader(r["payload"], r["index"], r["width"])
        found = shard.slot(k, occurrence)
        if found is not None:
            return shard.ids(found["offset"], found["length"])
        if r["last"] == k:  # the id may go on in the next shard; its rows here are counted by the same index
            occurrence -= count_of(shard, k)
    return None


def count_of(shard: ShardReader, key: int) -> int:
    """Occurrences of a key in a shard, by doubling and halving."""
    low, high = 0, 1
    while high <= shard.n and shard.slot(key, high - 1) is not None:
        low, high = high, 2 * high
    while low + 1 < high:
        middle = (low + high) // 2
        low, high = (middle, high) if shard.slot(key, middle - 1) is not None else (low, middle)
    return low


def describe(root: str, tokenizer: str, end_id: int) -> None:
    """A header file that names what the payloads hold."""
    store, path = common.open_store(root)
    with store.open_output_stream(f"{path}/header.json") as f:
        f.write(json.dumps({"format": "raw token ids", "byte_order": "little", "tokenizer": tokenizer.rpartition("/")[2], "end_id": end_id}).encode())


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokens import vocabulary

    root, tokenizer = common.shared_dir(spark, "token-files"), vocabulary("byte_bpe_50k.json")
    docs = common.table(spark, sf_dir, "documents")
    manifest = write_token_shards(docs, root, tokenizer, 2, max(common.shuffle_parts(spark), common.parts_for(docs, 64 << 20)))
    describe(root, tokenizer, 2)
    return read_token_shards(manifest)
