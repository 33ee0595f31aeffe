"""WARC files and a Merkle fixity audit of their replicas.

``write_archives`` writes pages as WARC/1.0 response records in ascending page id, each a gzip member of its own, an
archive for each range of ids, and returns an inventory (archive, record, id, offset and length as stored, size and
digest of the record itself) and the archives' files. ``read_archives`` parses archives back.

``tree`` hashes one replica: a leaf is the SHA-256 of the bytes at a record's offset range, read from the file; a node
hashes, in order, the offset range and hash of up to ``FANOUT`` nodes below it. A replica's tree is a table (archive,
node, first, past, hash, level), levels 0 (leaves) to the root, partitioned by level. ``audit`` compares a root for each
replica, then one for each archive, and then, level by level, only the nodes under a mismatch: intact replicas cost one
comparison, intact archives one, and a damaged one a path for each damaged record.

A node is made by the task that reads its archive; levels above are made in it, too, so no hash is shuffled to be
hashed. Damage to a length cannot move what follows: leaves are read at the inventory's ranges, and a file that ends
early has short leaves.

Cases: a null url or html is written as an empty one; a null page id comes first and has an empty record id; repeated
ids are separate records, ordered by url and html (an id of so many rows that it fills several archives is dealt to them
by a hash of those); an empty table has no archive and no finding; a replica that lacks an archive mismatches at every
record of it; a record is one page, however long, and must fit a task; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

FANOUT = 16
INVENTORY = "archive int, record long, page_id long, offset long, length long, size long, digest string"
TREE = "archive int, node long, first long, past long, hash string, level int"


def record(page_id: int | None, url: str | None, html: str | None) -> bytes:
    """A response record; dates are fixed, so equal pages are equal bytes."""
    body = (html or "").encode("utf-8", "surrogatepass")
    head = f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nWARC-Target-URI: {url or ''}\r\nContent-Type: text/html\r\nContent-Length: {len(body)}\r\n\r\n"
    return head.encode("utf-8", "surrogatepass") + body + b"\r\n\r\n"


def member(held: bytes) -> bytes:
    """A gzip member without a time or name, so equal records are equal bytes in every replica."""
    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
    return pack.compress(held) + pack.flush()


def write_archives(pages: DataFrame, roots: list[str], archives: int) -> tuple[DataFrame, DataFrame]:
    """Write the same archives below each root.

    Returns the inventory, a row for each record, and the files: (archive, files) with an archive's path in each replica.
    """
    data = pages.select(F.col("page_id").cast("long").alias("k"), F.col("url").alias("u"), F.col("html").alias("h"))
    splits = common.range_splits(data, "k", archives)
    dealt = data.withColumn("b", common.range_bucket("k", splits, F.xxhash64("u", "h"))).repartitionById(len(splits) + 1, F.col("b")).sortWithinPartitions("b", F.col("k").asc_nulls_first(), "u", "h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, archive, at, n, name = [], None, 0, 0, ""
        for batch in common.in_slices(batches, 256):
            rows = []
            for r in batch.to_pylist():
                if archive != r["b"]:
                    for f in out:
                        f.close()
                    archive, at, n, out, name = r["b"], 0, 0, [], f"archive-{r['b']:06d}-{uuid.uuid4().hex[:12]}.warc"
                    for root in roots:
                        store, path = common.open_store(f"{root}/{name}")
                        store.create_dir(path.rpartition("/")[0])
                        out.append(store.open_output_stream(path))
                held = record(r["k"], r["u"], r["h"])
                stored = member(held)
                for f in out:
                    f.write(stored)
                rows.append({"archive": archive, "record": n, "page_id": r["k"], "offset": at, "length": len(stored), "size": len(held), "digest": hashlib.sha256(held).hexdigest(), "name": name if n == 0 else None})
                at, n = at + len(stored), n + 1
            yield pa.RecordBatch.from_pylist(rows, _inventory())
        for f in out:
            f.close()

    written = common.durable(common.map_batches(dealt, run, f"{INVENTORY}, name string"), "inventory")
    paths = F.array(*[F.concat(F.lit(f"{root}/"), "name") for root in roots])
    return written.drop("name"), written.where("name is not null").select("archive", paths.alias("files"))


def _inventory() -> pa.Schema:
    return pa.schema([("archive", pa.int32()), ("record", pa.int64()), ("page_id", pa.int64()), ("offset", pa.int64()), ("length", pa.int64()), ("size", pa.int64()), ("digest", pa.string()), ("name", pa.string())])


def of_replica(files: DataFrame, replica: int) -> DataFrame:
    return files.select("archive", F.element_at("files", replica + 1).alias("file"))


def read_archives(inventory: DataFrame, files: DataFrame, replica: int = 0) -> DataFrame:
    """(page_id, url, html) parsed from a replica's files; a task that reads an archive's records in a row opens it once."""
    data = inventory.join(of_replica(files, replica), "archive")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, source = None, None
        for batch in common.in_slices(batches, 256):
            rows = []
            for r in batch.to_pylist():
                if opened != r["file"]:
                    store, path = common.open_store(r["file"])
                    opened, source = r["file"], store.open_input_file(path)
                head, _, body = zlib.decompress(source.read_at(r["length"], r["offset"]), 31).partition(b"\r\n\r\n")
                fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
                rows.append({"page_id": r["page_id"], "url": fields["WARC-Target-URI"], "html": body[: int(fields["Content-Length"])].decode("utf-8", "surrogatepass")})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("html", pa.string())]))

    return common.map_batches(data, run, "page_id long, url string, html string")


def damage(inventory: DataFrame, files: DataFrame, replica: int, where: Column, intact: int = 0) -> int:
    """Damage a byte near the end of the marked records as stored in one replica; how many. For drills.

    The byte becomes the complement of the intact replica's, so a repeated task does not mend what it damaged.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                store, path = common.open_store(r["files"][intact])
                with store.open_input_stream(path) as f:
                    held = bytearray(f.read())
                for at in r["at"]:
                    held[at] ^= 0xFF
                store, path = common.open_store(r["files"][replica])
                with store.open_output_stream(path) as f:
                    f.write(bytes(held))
                yield pa.RecordBatch.from_pydict({"n": [len(r["at"])]}, pa.schema([("n", pa.int64())]))

    marked = inventory.where(where).groupBy("archive").agg(F.collect_list(F.col("offset") + F.col("length") - 5).alias("at"))
    return common.map_batches(marked.join(files, "archive"), run, "n long").agg(F.sum("n")).first()[0] or 0


#: Bytes that a task reads of an archive at once.
READ = 8 << 20


def tree(inventory: DataFrame, files: DataFrame, replica: int) -> DataFrame:
    """The hash tree of every archive of a replica, partitioned by level: (archive, node, first, past, hash, level).

    An archive's ranges come to its task in order; hashes go up there. The archive is read in large blocks, once. The
    last node of an archive, of the level above its highest, is its root.
    """
    ordered = inventory.select("archive", "record", "offset", "length").join(of_replica(files, replica), "archive", "left")
    ordered = ordered.repartition("archive").sortWithinPartitions("archive", "record")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, source, size, pending, made = None, None, 0, [], []
        held, held_at = b"", 0

        def read(offset: int, length: int) -> bytes:
            """The bytes of a range as far as they are there."""
            nonlocal held, held_at
            if offset < held_at or offset + length > held_at + len(held):
                held = source.read_at(max(0, min(max(length, READ), size - offset)), offset) if offset < size else b""
                held_at = offset
            return held[offset - held_at : offset - held_at + length]

        def push(level: int, entry: tuple[int, int, str]) -> None:
            """Add a node at a level; a full row of children becomes a node of the level above."""
            while len(pending) <= level:
                pending.append([0, []])
            made.append((archive, pending[level][0], *entry, level))
            pending[level][0] += 1
            pending[level][1].append(entry)
            if len(pending[level][1]) == FANOUT:
                fold(level)

        def fold(level: int) -> None:
            below = pending[level][1]
            pending[level][1] = []
            h = hashlib.sha256("".join(f"{a}-{b}:{x};" for a, b, x in below).encode()).hexdigest()
            push(level + 1, (below[0][0], below[-1][1], h))

        def finish() -> None:
            level = 0
            while level < len(pending):
                if pending[level][1] and (pending[level][0] > 1 or level == 0):
                    fold(level)
                level += 1

        def rows() -> pa.RecordBatch:
            columns = list(zip(*made, strict=True)) or [()] * 6
            made.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, field.type) for c, field in zip(columns, _tree(), strict=True)], schema=_tree())

        for batch in common.in_slices(batches, 1024):
            for r in batch.to_pylist():
                if archive != r["archive"]:
                    if archive is not None:
                        finish()
                    archive, pending, held, held_at, source, size = r["archive"], [], b"", 0, None, 0
                    try:
                        store, path = common.open_store(r["file"])
                        source = store.open_input_file(path)
                        size = source.size()
                    except FileNotFoundError:
                        pass
                part = read(r["offset"], r["length"]) if source else b""
                push(0, (r["offset"], r["offset"] + r["length"], hashlib.sha256(part).hexdigest()))
            yield rows()
        if archive is not None:
            finish()
        yield rows()

    return common.durable(common.map_batches(ordered, run, TREE), "tree", ["level"])


def _tree() -> pa.Schema:
    return pa.schema([("archive", pa.int32()), ("node", pa.int64()), ("first", pa.int64()), ("past", pa.int64()), ("hash", pa.string()), ("level", pa.int32())])


def archive_roots(nodes: DataFrame) -> DataFrame:
    """(archive, level, hash): the highest node of each archive."""
    return nodes.groupBy("archive").agg(F.max_by(F.struct("level", "hash"), "level").alias("t")).select("archive", "t.level", "t.hash")


def replica_root(roots: DataFrame) -> str:
    """The hash of a replica: of its archives' roots in order (a row for each archive, on the driver)."""
    rows = sorted((r.archive, r.level, r.hash) for r in roots.collect())
    return hashlib.sha256("".join(f"{a}/{n}:{h};" for a, n, h in rows).encode()).hexdigest()


def audit(left: DataFrame, right: DataFrame) -> DataFrame:
    """(archive, record) of the leaves in which two replicas' trees differ.

    First one hash for each replica is compared, then a root for each archive, and then, level by level, only the
    children of nodes that mismatch: a level's partition is read, and of it what has a mismatching parent is kept before
    the two sides meet. So intact replicas cost their roots, and a damaged record a path. The number of levels is the
    logarithm of an archive's records, and the driver sees a root for each archive and counts.
    """
    none = left.select("archive", F.col("node").alias("record")).limit(0)
    tops = [common.durable(archive_roots(x), "roots") for x in (left, right)]
    if replica_root(tops[0]) == replica_root(tops[1]):
        return none
    a, b = (x.select("archive", F.col("level").alias(n), F.col("hash").alias(h)) for x, n, h in ((tops[0], "n", "l"), (tops[1], "m", "r")))
    bad = a.join(b, "archive", "full").where(~F.col("l").eqNullSafe(F.col("r"))).select("archive", F.greatest("n", "m").alias("level"))
    wrong = common.durable(bad, "wrong")
    highest = wrong.agg(F.max("level")).first()[0]
    parents = None
    for level in range(highest, -1, -1):
        sides = []
        for x, h in ((left, "l"), (right, "r")):
            here = x.where(F.col("level") == level).select("archive", "node", F.col("hash").alias(h))
            wanted = here.join(wrong.where(F.col("level") == level).select("archive"), "archive", "left_semi")
            if parents is not None:
                children = here.withColumn("parent", F.floor(F.col("node") / FANOUT)).join(parents, ["archive", "parent"], "left_semi")
                wanted = wanted.union(children.select("archive", "node", h))
            sides.append(wanted)
        differ = sides[0].join(sides[1], ["archive", "node"], "full").where(~F.col("l").eqNullSafe(F.col("r"))).select("archive", "node")
        found = common.durable(differ, "mismatch")
        parents = found.select("archive", F.col("node").alias("parent"))
    return found.select("archive", F.col("node").alias("record"))


def fixity(pages: DataFrame, archives: int, damaged: Column) -> DataFrame:
    """A drill: two replicas, damage in the second, and the audit's finding for every record."""
    spark = pages.sparkSession
    root = common.shared_dir(spark, "archives")
    inventory, files = write_archives(pages, [f"{root}/a", f"{root}/b"], archives)
    damage(inventory, files, 1, damaged)
    found = audit(tree(inventory, files, 0), tree(inventory, files, 1)).withColumn("mismatch", F.lit(True))
    joined = inventory.join(found, ["archive", "record"], "left")
    return joined.select("page_id", "archive", "record", "offset", "length", "size", "digest", F.coalesce("mismatch", F.lit(False)).alias("mismatch"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's record, its hash, and whether the audit finds it damaged, as it is for ids whose crc32 is 0 mod 50."""
    pages = common.table(spark, sf_dir, "pages")
    archives = max(common.shuffle_parts(spark), common.parts_for(pages, 256 << 20))
    found = fixity(pages, archives, F.coalesce(common.id_fold("page_id", 50) == 0, F.lit(False)))
    return found.select("page_id", F.col("size").alias("length"), F.col("digest").alias("record_sha256"), "mismatch")


#: DuckDB has no crc32, so the SQL states the records' bytes and hashes; the damaged ids come from a table of crc32.
SQL = r"""
WITH RECURSIVE steps(i, n, c) AS (
  SELECT i, 0, i FROM range(256) t(i)
  UNION ALL
  SELECT i, n + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM steps WHERE n < 8),
entries AS (SELECT list(c ORDER BY i) AS t FROM steps WHERE n = 8),
r AS (
  SELECT page_id, 'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10)
      || 'WARC-Record-ID: <urn:page:' || coalesce(page_id::VARCHAR, '') || '>' || chr(13) || chr(10)
      || 'WARC-Date: 1970-01-01T00:00:00Z' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10)
      || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10)
      || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS record,
    list_reduce(list_prepend(4294967295, list_transform(string_split(page_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
      lambda c, b: xor(c >> 8, list_extract(t, (xor(c, b) & 255) + 1))) AS crc
  FROM pages, entries)
SELECT page_id, strlen(record)::BIGINT AS length, sha256(record) AS record_sha256,
       coalesce(xor(crc, 4294967295) % 50 = 0, false) AS mismatch
FROM r
"""
