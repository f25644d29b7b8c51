"""Merkle fixity audit of WARC archives.

Records are laid out in archives by offset and hashed; a node of the lowest level hashes the records of one offset range, and
each further level hashes up to FANOUT nodes, first within an archive, then over archives, up to one root. Two replicas are
compared from the root down: only children of nodes that differ are looked at, and only records in ranges that differ. Those
are aligned by id and digest, so that a record that was lost or slipped in is one finding, though others moved.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from nearfield.llm._common import checkpointed, read

#: Bytes of a range of the lowest level, children of a node above, ids in one archive.
RANGE_BYTES, FANOUT, ARCHIVE_IDS = 1 << 18, 16, 1000


def warc_record(record_id: Column, url: Column, payload: Column) -> Column:
    """The WARC resource record of a payload; nulls count as empty."""
    payload = F.coalesce(payload, F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), F.coalesce(record_id.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nContent-Length: "), F.octet_length(payload).cast("string"),
        F.lit("\r\n\r\n"), payload, F.lit("\r\n\r\n"),
    )


def hashed(pages: DataFrame, page_id: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """(archive, id, bytes, digest, copies) of the records of ``pages``.

    An archive holds the records of ARCHIVE_IDS successive ids (cast to bigint); records without an id go to one of 256
    archives with numbers below 0 by their digest. Equal records are one row with its number of copies.
    """
    record = warc_record(F.col(page_id), F.col(url), F.col(payload))
    rows = pages.select(F.col(page_id).cast("bigint").alias("id"), F.sha2(record, 256).alias("digest"), F.octet_length(record).cast("bigint").alias("bytes"))
    unnumbered = -1 - F.conv(F.substring("digest", 1, 2), 16, 10).cast("bigint")
    archive = F.when(F.col("id").isNull(), unnumbered).otherwise(F.floor(F.col("id") / ARCHIVE_IDS)).cast("bigint")
    return rows.withColumn("archive", archive).groupBy("archive", "id", "bytes", "digest").agg(F.count("*").alias("copies"))


def records(pages: DataFrame, page_id: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """hashed() with the offset of each record in its archive, by id and digest.

    Where an archive has an index of its own, give audit() its offsets instead: any DataFrame with these columns will do.
    """
    before = Window.partitionBy("archive").orderBy("id", "digest").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum(F.col("bytes") * F.col("copies")).over(before), F.lit(0))
    return hashed(pages, page_id, url, payload).withColumn("offset", offset)


@dataclass
class MerkleTree:
    """Records and the levels of digests over them: (hi, lo, digest), from offset ranges up to the root."""

    records: DataFrame
    levels: list[DataFrame]


def _level(children: DataFrame, hi: Column, lo: Column, order: list[str], value: Column) -> DataFrame:
    """Digests of groups of children; a group has at most FANOUT nodes or the records of one range."""
    listed = F.array_sort(F.collect_list(F.struct(*order, value.alias("_value"))))
    joined = F.concat_ws(";", F.transform(listed, lambda s: F.concat_ws(":", *(s[c].cast("string") for c in order), s["_value"])))
    return children.groupBy(hi.alias("hi"), lo.alias("lo")).agg(F.sha2(joined, 256).alias("digest"))


def build(rows: DataFrame, low_levels: int, high_levels: int, first: int = 0) -> MerkleTree:
    """The tree over ``rows`` (of records()): ``low_levels`` levels above the ranges of an archive, ``high_levels`` above archives.

    Archives are numbered from ``first`` on. ``rows`` are read for the ranges and again by audit(), so checkpoint them before.
    """
    ranges = _level(rows, F.col("archive") - first, F.floor(F.col("offset") / RANGE_BYTES).cast("bigint"), ["offset", "copies"], F.col("digest"))
    levels = [checkpointed(ranges)]
    for _ in range(low_levels):
        levels.append(checkpointed(_level(levels[-1], F.col("hi"), F.floor(F.col("lo") / FANOUT).cast("bigint"), ["lo"], F.col("digest"))))
    for _ in range(high_levels):
        levels.append(checkpointed(_level(levels[-1], F.floor(F.col("hi") / FANOUT).cast("bigint"), F.lit(0).cast("bigint"), ["hi"], F.col("digest"))))
    return MerkleTree(rows, levels)


def heights(*replicas: DataFrame) -> tuple[int, int, int]:
    """Levels that trees over all ``replicas`` need to have one root, within archives and above them, and the first archive."""
    ends = [r.agg(F.max("offset"), F.min("archive"), F.max("archive")).first() for r in replicas]
    ends = [e for e in ends if e[0] is not None]
    if not ends:
        return 0, 0, 0
    top, low = max(e[0] for e in ends) // RANGE_BYTES, 0
    while top:
        top, low = top // FANOUT, low + 1
    first = min(e[1] for e in ends)
    span, high = max(e[2] for e in ends) - first, 0
    while span:
        span, high = span // FANOUT, high + 1
    return low, high, first


def audit(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """(archive, id, offset, status, copies, replica_copies, digest, replica_digest) of every record that isn't the same in both.

    Both come from records(). status is altered (another record under the id), missing (the primary has it, or more copies of
    it) or extra (the replica has). A record that only moved is no finding. Empty replicas are equal to each other.
    """
    primary, replica = checkpointed(primary), checkpointed(replica)
    low, high, first = heights(primary, replica)
    a, b = build(primary, low, high, first), build(replica, low, high, first)
    wrong: DataFrame | None = None
    for k in range(low + high, -1, -1):
        left, right = a.levels[k], b.levels[k]
        if wrong is not None:  # only children of nodes that differ
            if k >= low:
                up = [F.floor(F.col("hi") / FANOUT).cast("bigint"), F.lit(0).cast("bigint")]
            else:
                up = [F.col("hi"), F.floor(F.col("lo") / FANOUT).cast("bigint")]
            left, right = (t.withColumns({"_hi": up[0], "_lo": up[1]}).join(wrong, ["_hi", "_lo"], "left_semi").drop("_hi", "_lo") for t in (left, right))
        right = right.withColumnRenamed("digest", "other")
        differ = left.join(right, ["hi", "lo"], "full").where(~F.col("digest").eqNullSafe(F.col("other")))
        wrong = checkpointed(differ.select(F.col("hi").alias("_hi"), F.col("lo").alias("_lo")))
    place = {"_hi": F.col("archive") - first, "_lo": F.floor(F.col("offset") / RANGE_BYTES).cast("bigint")}
    side = [t.records.withColumns(place).join(wrong, ["_hi", "_lo"], "left_semi").withColumn("which", F.lit(i)) for i, t in enumerate((a, b))]
    # a side at a time by id and digest: what both have drops out, and what is left of an id is paired in the order of digests
    rows = side[0].unionByName(side[1])
    own = lambda i, c: F.max(F.when(F.col("which") == i, F.col(c)))
    copies = lambda i: F.sum(F.when(F.col("which") == i, F.col("copies")).otherwise(0))
    both = rows.groupBy("archive", "id", "digest").agg(own(0, "offset").alias("o0"), own(1, "offset").alias("o1"), copies(0).alias("n0"), copies(1).alias("n1")).where("n0 <> n1")
    alone = F.when(F.col("n1") == 0, 0).when(F.col("n0") == 0, 1).otherwise(2)
    place = F.row_number().over(Window.partitionBy("archive", "id", "alone").orderBy("digest"))
    pairs = both.withColumn("alone", alone).withColumn("place", place)
    # a record with copies on both sides stands for itself
    group = [F.col("archive"), F.col("id"), F.col("alone") == 2, F.col("place")]
    got = pairs.groupBy(*(g.alias(n) for g, n in zip(group, ("archive", "id", "same", "place"), strict=True))).agg(
        F.coalesce(F.max("o0"), F.max("o1")).alias("offset"), F.sum("n0").alias("copies"), F.sum("n1").alias("replica_copies"),
        F.max(F.when(F.col("n0") > 0, F.col("digest"))).alias("digest"), F.max(F.when(F.col("n1") > 0, F.col("digest"))).alias("replica_digest"),
    )
    paired = ~F.col("same") & (F.col("copies") > 0) & (F.col("replica_copies") > 0)
    status = F.when(paired, "altered").when(F.col("copies") > F.col("replica_copies"), "missing").otherwise("extra")
    return got.select("archive", "id", "offset", status.alias("status"), "copies", "replica_copies", "digest", "replica_digest")


def damaged(pages: DataFrame) -> DataFrame:
    """``pages`` as a replica with known damage, for the audit to find.

    Pages with id 5 modulo 97 have a first character that rotted, those with 7 modulo 101 are lost, and for those with 9
    modulo 103 there is a stray record beside.
    """
    rot = (F.col("page_id") % 97 == 5) & (F.length("html") > 0)
    lost = F.coalesce(F.col("page_id") % 101 == 7, F.lit(False))
    html = F.when(rot, F.concat(F.lit("#"), F.expr("substr(html, 2)"))).otherwise(F.col("html"))
    kept = pages.select("page_id", "url", html.alias("html")).where(~lost)
    return kept.unionByName(pages.where("page_id % 103 = 9").select("page_id", "url", F.lit("stray").alias("html")))


def op7_merkle_audit(spark, sf_dir: str) -> DataFrame:
    """The findings of audit() between the records of ``pages`` and those of a damaged() replica.

    Null ids, urls and pages are records like others, repeated rows are copies, and an empty table has no findings.
    """
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    return audit(records(pages), records(damaged(pages)))


_RECORDS = """SELECT archive, id, digest, copies, coalesce(sum(bytes * copies) OVER (PARTITION BY archive ORDER BY id NULLS FIRST, digest ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset"
  FROM (SELECT CASE WHEN id IS NULL THEN -1 - ('0x' || substr(digest, 1, 2))::BIGINT ELSE floor(id / 1000)::BIGINT END AS archive, id, bytes, digest, count(*) AS copies
    FROM (SELECT page_id AS id, sha256(record) AS digest, strlen(record)::BIGINT AS bytes FROM (
      SELECT page_id, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || coalesce(page_id::VARCHAR, '') || '>' || chr(13) || chr(10)
        || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS record
      FROM {table})) GROUP BY ALL)"""
ORACLE_SQL = f"""
WITH damaged AS (SELECT page_id, url, CASE WHEN page_id % 97 = 5 AND length(html) > 0 THEN '#' || substr(html, 2) ELSE html END AS html FROM pages WHERE NOT coalesce(page_id % 101 = 7, false)
  UNION ALL SELECT page_id, url, 'stray' FROM pages WHERE page_id % 103 = 9),
a AS ({_RECORDS.format(table="pages")}),
b AS ({_RECORDS.format(table="damaged")}),
differ AS (SELECT coalesce(a.archive, b.archive) AS archive, coalesce(a.id, b.id) AS id, a.digest AS da, b.digest AS db, a."offset" AS oa, b."offset" AS ob, coalesce(a.copies, 0) AS na, coalesce(b.copies, 0) AS nb
  FROM a FULL JOIN b ON a.archive = b.archive AND a.id IS NOT DISTINCT FROM b.id AND a.digest = b.digest WHERE a.copies IS DISTINCT FROM b.copies),
l AS (SELECT *, row_number() OVER (PARTITION BY archive, id ORDER BY da) AS k FROM differ WHERE nb = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY archive, id ORDER BY db) AS k FROM differ WHERE na = 0)
SELECT archive, id, coalesce(oa, ob) AS "offset", CASE WHEN na > nb THEN 'missing' ELSE 'extra' END AS status, na::BIGINT AS copies, nb::BIGINT AS replica_copies, da AS digest, db AS replica_digest FROM differ WHERE na > 0 AND nb > 0
UNION ALL SELECT coalesce(l.archive, r.archive), coalesce(l.id, r.id), coalesce(l.oa, r.ob), CASE WHEN r.db IS NULL THEN 'missing' WHEN l.da IS NULL THEN 'extra' ELSE 'altered' END,
  coalesce(l.na, 0)::BIGINT, coalesce(r.nb, 0)::BIGINT, l.da, r.db
FROM l FULL JOIN r ON l.archive = r.archive AND l.id IS NOT DISTINCT FROM r.id AND l.k = r.k
"""
