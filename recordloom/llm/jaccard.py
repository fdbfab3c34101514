"""N-gram Jaccard join: documents with one prefix form a group, groups give candidates, members are verified."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recordloom.llm.components import components
from recordloom.llm.hot import join_counted
from recordloom.llm.simhash import _roots as smallest_connected
from recordloom.llm.text_arrays import lower_ascii, pack, raw_bytes, slices
from recordloom.operators.shared import new_folder, saved

SHINGLE = 3
PERCENT = 90
#: Members of a list outside its largest component that one task holds, and members that pass by them.
HELD, PASSING = 1 << 12, 1 << 16
#: Pairs of one document that are verified in one task.
PAIRS = 1 << 12
#: A set's bitmap: 512 bits in eight columns.
WORDS_OF_BITS = tuple(f"b{i}" for i in range(8))
BITS = 64 * len(WORDS_OF_BITS)
#: Bits of the wider bitmap that stands beside a whole set.
WIDE_BITS = 2048
#: Lists of a member that look for hubs: those that most others are in.
HUB_LISTS = 3
HUB_TURNS = 4
#: Links whose components one task finds, 16 bytes each.
SMALL_GRAPH = 1 << 20
#: Bits that tell which texts cannot be needed: 8 MB.
SIEVE_BITS = 1 << 26
#: Sets of one bucket of the stored table, and most buckets.
BUCKET_SETS, BUCKETS = 1 << 14, 50_000


def overlap(n, percent: int = PERCENT):
    """Least number of shared shingles of a set of n with any set it links to, which has as many at least."""
    return -(-percent * n // 100)


def surely_shared(n, percent: int = PERCENT):
    """How many of the shared shingles the prefixes of two linked sets of n and more hold for certain."""
    return np.maximum(1, (n - overlap(n, percent) + 2) // 2)


def prefix_length(n, percent: int = PERCENT):
    """Of the smallest hashes of n: what may be missing in a linked set, and ``surely_shared`` more."""
    return n - overlap(n, percent) + surely_shared(n, percent)


def left_out(n, percent: int = PERCENT):
    """How many of the most frequent shingles of a prefix need no list: one less than any linked set shares."""
    return surely_shared(overlap(n, percent), percent) - 1


def smallest_linked(percent: int = PERCENT) -> int:
    """A smaller set links to equal sets only: one more shingle is already too much."""
    return -(-percent // (100 - percent)) if percent < 100 else 1 << 62


def _shingle_sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit hashes of the k-word shingles, ascending per text, and where each text begins."""
    digest = xxhash.xxh64_intdigest
    data, offsets = raw_bytes(texts)
    words = pack(lower_ascii(data), offsets)
    text = words.text()
    short = np.flatnonzero((words.n_words > 0) & (words.n_words < k))
    begin = words.windows(k)
    spans = zip(
        np.concatenate([words.starts[begin], words.starts[words.first[short]]]).tolist(),
        np.concatenate([words.ends[begin + k - 1], words.ends[words.first[short + 1] - 1]]).tolist(),
        strict=True,
    )
    hashes = np.array([digest(text[a:b]) for a, b in spans], dtype=np.uint64)
    row = np.concatenate([np.repeat(np.arange(len(texts)), np.maximum(words.n_words - k + 1, 0)), short])
    order = np.lexsort((hashes, row))
    hashes, row = hashes[order], row[order]
    new = np.ones(len(row), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
    return hashes[new], np.searchsorted(row[new], np.arange(len(texts) + 1))


def _bitmaps(hashes: np.ndarray, upto: np.ndarray, bits: int = BITS) -> np.ndarray:
    """``bits`` bits per text: whether an odd number of its hashes falls on each. Sets differ by as many at least."""
    n = len(upto) - 1
    at = np.repeat(np.arange(n), np.diff(upto)) * bits + (hashes & np.uint64(bits - 1)).astype(np.int64)
    odd = (np.bincount(at, minlength=bits * n) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(n, bits), axis=1, bitorder="little").view(np.uint64).reshape(n, bits // 64)


def _prefixes(k: int, percent: int):
    """Per text: size and digest of its set; once per task and set the prefix, its digest and the bitmap."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in slices(batches, "_text"):
            hashes, upto = _shingle_sets(batch.column("_text"), k)
            n = np.diff(upto)
            bits = _bitmaps(hashes, upto)
            length = prefix_length(n, percent)
            keys, prefix_keys, prefixes = [], [], []
            for i, (a, b) in enumerate(zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True)):
                own = hashes[a:b]
                keys.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
                if keys[-1] in seen or b - a < smallest_linked(percent):
                    prefix_keys.append(None)
                    prefixes.append(None)
                    continue
                seen.add(keys[-1])
                prefix = own[: length[i]]
                prefix_keys.append(hashlib.blake2b(prefix.tobytes(), digest_size=16, salt=(b - a).to_bytes(8, "little")).digest())
                prefixes.append(prefix.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("_id"),
                    batch.column("_of_text"),
                    pa.array(n.astype(np.int64)),
                    pa.array(keys, pa.binary()),
                    pa.array(prefix_keys, pa.binary()),
                    pa.array(prefixes, pa.list_(pa.int64())),
                    *[pa.array(bits[:, i].copy().view(np.int64)) for i in range(len(WORDS_OF_BITS))],
                ],
                names=["_id", "_of_text", "n", "_set", "_group", "prefix", *WORDS_OF_BITS],
            )

    return work


def _whole_sets(k: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in slices(batches, "_text"):
            of = batch.column("cid").to_pylist()
            new = [i for i, key in enumerate(of) if key not in seen and not seen.add(key)]
            part = batch.take(pa.array(new, pa.int64()))
            hashes, upto = _shingle_sets(part.column("_text"), k)
            sets = pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), pa.array(hashes.view(np.int64)))
            wide = _bitmaps(hashes, upto, WIDE_BITS).view(np.int64).reshape(-1)
            wide = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * (WIDE_BITS // 64)), pa.array(wide))
            yield pa.RecordBatch.from_arrays([part.column("cid"), sets, wide], names=["cid", "set", "wide"])

    return work


def _lists(classes: DataFrame, percent: int) -> DataFrame:
    """(own, token, cid, central, nth): the lists in which members of linked classes are sure to meet.

    Lists are made of groups, the classes with one size and one prefix. Of a prefix, tokens that no other
    group has need no list; of the rest the ``left_out`` most frequent need none either. So a group whose
    prefix has no more shared tokens than that is in no list. Members are put back at the end; those of
    one group share a list of their own. ``nth`` is 1 for the longest list of a member.
    """
    groups = classes.filter("prefix is not null")
    entries = groups.select("gid", F.explode("prefix").alias("token"))
    shared = saved(entries.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1"))
    shared = join_counted(entries, shared, ["token"], "df")
    least = F.floor((F.lit(percent) * F.col("n") + 99) / 100)
    out = F.greatest(F.lit(1), F.floor((least - F.floor((F.lit(percent) * least + 99) / 100) + 2) / 2)) - 1
    sizes = groups.select("gid", out.alias("out"), F.size("prefix").alias("length"))
    group = Window.partitionBy("gid")
    shared = shared.select(
        "gid", "token", F.count("*").over(group).alias("n_shared"), F.row_number().over(group.orderBy(F.desc("df"), F.desc("token"))).alias("nth")
    )
    index = shared.join(sizes, "gid").filter("nth > out").select(
        "gid", "token", (F.col("n_shared") / F.col("length")).alias("central"), (F.col("nth") - F.col("out")).alias("nth")
    )
    members = classes.select("gid", "cid")
    several = members.groupBy("gid").count().filter("count > 1").select("gid")
    own = members.join(several, "gid").select(
        F.lit(True).alias("own"), F.col("gid").alias("token"), "cid", F.lit(0.0).alias("central"), F.lit(1).alias("nth")
    )
    return index.join(members, "gid").select(F.lit(False).alias("own"), "token", "cid", "central", "nth").unionByName(own)


def _may_link(a: str, b: str, percent: int):
    """Sizes and bitmaps of two rows allow a link: never false for linked sets."""
    both = F.col(f"{a}n") + F.col(f"{b}n")
    near = F.lit(100) * F.least(f"{a}n", f"{b}n") >= F.lit(percent) * F.greatest(f"{a}n", f"{b}n")
    far = sum((F.bit_count(F.col(f"{a}{w}").bitwiseXOR(F.col(f"{b}{w}"))) for w in WORDS_OF_BITS), F.lit(0))
    return near & (far * (100 + percent) <= both * (100 - percent))


def _in_one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for batch in batches:
        a.append(np.asarray(batch.column("a")))
        b.append(np.asarray(batch.column("b")))
    nodes, at = np.unique(np.concatenate([*a, *b]), return_inverse=True)
    half = len(at) // 2
    root = smallest_connected(len(nodes), at[:half], at[half:])
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], names=["cid", "root"])


def _roots(links: DataFrame) -> DataFrame:
    """(cid, root), saved: the smallest class of the component of each class that has a link (a, b).

    Up to SMALL_GRAPH links fit a task; more are contracted by joins.
    """
    links = saved(links.select("a", "b"))
    if links.count() <= SMALL_GRAPH:
        return saved(links.coalesce(1).mapInArrow(_in_one_task, "cid long, root long"))
    return saved(components(links).select(F.col("node").alias("cid"), "root"))


def _labelled(lists: DataFrame, roots: DataFrame | None) -> DataFrame:
    if roots is None:
        return lists.withColumn("root", F.col("cid"))
    return lists.join(roots, "cid", "left").withColumn("root", F.coalesce("root", "cid"))


def _with(roots: DataFrame, links: DataFrame) -> DataFrame:
    return roots.filter("cid <> root").select(F.col("cid").alias("a"), F.col("root").alias("b")).unionByName(links)


def _to_hubs(rows: DataFrame, turn: int, percent: int) -> DataFrame:
    """Pairs of each list's hub with its other members, in lists that hold several components.

    The first hub is the member with most of its prefix shared, as the origin of many changed copies has;
    later ones are picked by a hash.
    """
    order = [F.col("central"), -F.col("cid")] if turn == 0 else [F.xxhash64("token", "cid", F.lit(turn)), F.col("cid")]
    fields = ["cid", "n", *WORDS_OF_BITS, "root"]
    hubs = rows.groupBy("own", "token").agg(
        F.max(F.struct(*order, F.struct(*[F.col(f).alias(f"h_{f}") for f in fields]).alias("hub"))).alias("best"),
        F.count("*").alias("_n"),
        (F.min("root") < F.max("root")).alias("several"),
    )
    hubs = saved(hubs.filter("several").select("own", "token", "best.hub.*", "_n"))
    met = join_counted(rows, hubs, ["own", "token"], "_n").filter((F.col("root") != F.col("h_root")) & _may_link("", "h_", percent))
    return met.select(F.least("cid", "h_cid").alias("a"), F.greatest("cid", "h_cid").alias("b")).distinct()


def _across(percent: int, cells: int = 1 << 20):
    """Per part of a list: the members held against those that pass, where roots differ and a link is possible."""

    def met(held: dict, now: dict) -> Iterator[pa.RecordBatch]:
        step = max(1, cells // max(1, len(held["cid"])))
        for i in range(0, len(now["cid"]), step):
            x = {name: values[i : i + step] for name, values in now.items()}
            far = np.zeros((len(x["cid"]), len(held["cid"])), dtype=np.int64)
            for w in WORDS_OF_BITS:
                far += np.bitwise_count(x[w][:, None] ^ held[w][None, :])
            n, m = x["n"][:, None], held["n"][None, :]
            ok = (x["root"][:, None] != held["root"][None, :]) & (far * (100 + percent) <= (n + m) * (100 - percent))
            ok &= 100 * np.minimum(n, m) >= percent * np.maximum(n, m)
            p, q = np.nonzero(ok)
            a, b = x["cid"][p], held["cid"][q]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("cid", "n", "root", *WORDS_OF_BITS)
        key, held = None, None
        for batch in batches:
            column = {c: np.asarray(batch.column(c)) for c in ("token", "part", "chunk", *names)}
            for w in WORDS_OF_BITS:
                column[w] = column[w].view(np.uint64)
            for c in ("own", "passing"):
                column[c] = np.asarray(batch.column(c).cast(pa.int8()))
            change = np.zeros(batch.num_rows, dtype=bool)
            for c in ("own", "token", "part", "chunk"):
                change[1:] |= column[c][1:] != column[c][:-1]
            cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                if i == j:
                    continue
                now = tuple(int(column[c][i]) for c in ("own", "token", "part", "chunk"))
                middle = i + int(np.searchsorted(column["passing"][i:j], 1))
                new = {c: column[c][i:middle] for c in names}
                held = new if now != key else {c: np.concatenate([held[c], new[c]]) for c in names}
                key = now
                yield from met(held, {c: column[c][middle:j] for c in names})

    return work


def _all_across(rows: DataFrame, about: DataFrame, percent: int, held: int, passing: int) -> DataFrame:
    """All pairs of members of one list that lie in different components and may link.

    Members of a list's largest component need not meet each other: the others are held, ``held`` at a
    time, and all members pass by them, ``passing`` at a time, so a long list is many small parts.
    """
    of_root = rows.groupBy("own", "token", "root").agg(F.count("*").alias("_n"))
    lists = of_root.groupBy("own", "token").agg(F.max(F.struct("_n", "root")).alias("top"), F.sum("_n").alias("_n"))
    lists = lists.filter(F.col("top._n") < F.col("_n")).select(
        "own",
        "token",
        F.col("top.root").alias("largest"),
        F.ceil((F.col("_n") - F.col("top._n")) / held).cast("int").alias("parts"),
        F.ceil(F.col("_n") / passing).cast("int").alias("chunks"),
        "_n",
    )
    rows = join_counted(rows, saved(lists), ["own", "token"], "_n").join(about, "cid")
    names = ["own", "token", "part", "chunk", "passing", "cid", "n", "root", *WORDS_OF_BITS]

    def own_of(number: str) -> F.Column:
        return F.array(F.pmod(F.xxhash64("cid"), F.col(number)).cast("int"))

    def every(number: str) -> F.Column:
        return F.sequence(F.lit(0), F.col(number) - 1)

    hold = rows.filter("root <> largest").withColumn("part", F.explode(own_of("parts")))
    hold = hold.withColumn("chunk", F.explode(every("chunks"))).withColumn("passing", F.lit(False))
    go = rows.withColumn("part", F.explode(every("parts"))).withColumn("chunk", F.explode(own_of("chunks")))
    both = hold.select(*names).unionByName(go.withColumn("passing", F.lit(True)).select(*names))
    both = both.repartition("own", "token", "part", "chunk").sortWithinPartitions("own", "token", "part", "chunk", "passing")
    return both.mapInArrow(_across(percent), "a long, b long").distinct()


def _texts_of(texts: DataFrame, needed: DataFrame) -> DataFrame:
    """(cid, _text): the texts of the needed classes, each at least once.

    Texts that cannot be needed stay where they are: the needed digests are spread over SIEVE_BITS bits, of
    which the words that have any set are broadcast, so there are SIEVE_BITS / 64 of them at most. Beyond some
    ten million classes the sieve fills up and lets more texts through to the join, which decides.
    """
    bit = F.pmod(F.xxhash64("_of_text"), F.lit(SIEVE_BITS))
    word, in_word = F.shiftright(bit, 6), F.lit(1).cast("long")
    # Shifts by a column are SQL functions only.
    mask = F.call_function("shiftleft", in_word, F.pmod(bit, F.lit(64)).cast("int"))
    sieve = saved(needed.groupBy(word.alias("_word")).agg(F.bit_or(mask).alias("_bits")))
    passed = texts.withColumn("_word", word).join(F.broadcast(sieve), "_word").filter(F.col("_bits").bitwiseAND(mask) != 0)
    # By shuffling at every size: what is needed grows with the documents.
    return passed.select("_of_text", "_text").join(needed.hint("merge"), "_of_text").select("cid", "_text")


def _stored(sets: DataFrame, n: int) -> str:
    """The name of a table of the sets in buckets of ``cid``: joins on it shuffle the other side only."""
    buckets = min(BUCKETS, max(8, -(-n // BUCKET_SETS)))
    name = f"sets_{uuid.uuid4().hex}"
    # A text that several documents have may come from several tasks.
    rows = sets.repartition(buckets, "cid").dropDuplicates(["cid"]).withColumn("n", F.size("set"))
    rows = rows.write.bucketBy(buckets, "cid").sortBy("cid")
    rows.option("path", new_folder(sets.sparkSession, "sets")).saveAsTable(name)
    return name


def _near_enough(pairs: DataFrame, sets: str, percent: int) -> DataFrame:
    """The pairs whose wider bitmaps allow a link."""
    stored = pairs.sparkSession.table(sets)
    met = pairs.join(stored.select("cid", F.col("n").alias("n_b"), F.col("wide").alias("wide_b")), F.col("b") == F.col("cid")).drop("cid")
    met = met.join(stored.select("cid", F.col("n").alias("n_a"), F.col("wide").alias("wide_a")), F.col("a") == F.col("cid")).drop("cid")
    words = F.zip_with("wide_a", "wide_b", lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    far = F.aggregate(words, F.lit(0), lambda total, x: total + x)
    return met.filter(far * (100 + percent) <= (F.col("n_a") + F.col("n_b")) * (100 - percent)).select(*pairs.columns)


def _verified(pairs: DataFrame, sets: str, percent: int) -> DataFrame:
    """The pairs whose sets link.

    First the wider bitmaps are compared, so sets are sent only where a link is all but certain. A
    document in very many pairs has its set copied, so its pairs spread over tasks.
    """
    names = pairs.columns
    pairs = saved(_near_enough(pairs, sets, percent))
    parts = saved(pairs.groupBy("a").agg(F.ceil(F.count("*") / PAIRS).cast("int").alias("parts")).filter("parts > 1"))
    stored = pairs.sparkSession.table(sets)
    first, second = (stored.select("cid", F.col("set").alias(name)) for name in ("set_a", "set_b"))
    pairs = pairs.join(second, F.col("b") == F.col("cid")).drop("cid")
    if parts.isEmpty():
        pairs = pairs.join(first, F.col("a") == F.col("cid")).drop("cid")
    else:
        first = first.withColumnRenamed("cid", "a")
        pairs = pairs.join(parts, "a", "left").withColumn("part", F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1))).cast("int"))
        first = first.join(parts, "a", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
        pairs = pairs.join(first.drop("parts"), ["a", "part"])
    common = F.size(F.array_intersect("set_a", "set_b"))
    union = F.size("set_a") + F.size("set_b") - common
    return pairs.filter(F.lit(100) * common >= F.lit(percent) * union).select(*names)


def jaccard_components(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    k: int = SHINGLE,
    percent: int = PERCENT,
    held: int = HELD,
    passing: int = PASSING,
) -> DataFrame:
    """One row per document: id, n_shingles, component_id (the smallest id reachable by links).

    Sets of k-word shingles link when 100 * intersection >= percent * union. Documents with one set are one
    class, classes with one size and one prefix one group. A prefix holds the smallest hashes of a set, so
    many that prefixes of linked sets share a known number of them; of these only the rarest need a list
    (see ``_lists``), so passages that stand in very many documents bring no documents together. In each
    list first a hub meets the members, then, after joining what linked, all members of different
    components meet. Pairs that sizes and bitmaps allow are verified by the whole sets. Pairs inside a
    component are never made, so a large group of near copies costs as much as its members.

    Sets are compared by 64-bit hashes of the shingles. Texts with fewer than k words are one shingle, all their
    words; null, empty and blank texts have none and link to nothing, not to each other either
    (component_id is their own id). A null id is never the smallest; a component of null ids has a null
    id. Repeated rows are rows of one class. Empty input gives no rows. Other columns are not read.
    """
    texts = docs.select(
        F.col(id_col).alias("_id"),
        F.col(text_col).alias("_text"),
        F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")))).alias("_of_text"),
    )
    kind = texts.schema["_id"].dataType.simpleString()
    bits = ", ".join(f"{w} long" for w in WORDS_OF_BITS)
    schema = f"_id {kind}, _of_text binary, n long, _set binary, _group binary, prefix array<long>, {bits}"
    rows = saved(texts.mapInArrow(_prefixes(k, percent), schema))

    classes = rows.filter("prefix is not null").drop("_id").repartition("_group").dropDuplicates(["_group", "_set"])
    classes = classes.withColumn("cid", F.monotonically_increasing_id())
    classes = classes.withColumn("gid", F.min("cid").over(Window.partitionBy("_group"))).drop("_group")
    classes = saved(classes.withColumn("prefix", F.when(F.col("cid") == F.col("gid"), F.col("prefix"))))

    lists = saved(_lists(classes, percent))
    about = classes.select("cid", "n", *WORDS_OF_BITS)
    needed = saved(classes.join(lists.select("cid").distinct(), "cid", "left_semi").select("cid", "_of_text"))
    own = _texts_of(texts, needed).mapInArrow(_whole_sets(k), "cid long, set array<long>, wide array<long>")
    sets = _stored(own, needed.count())

    near = saved(lists.filter(F.col("nth") <= HUB_LISTS).join(about, "cid"))
    roots, tried = None, None
    for turn in range(HUB_TURNS):  # as long as hubs join a good part of what they meet
        pairs = _to_hubs(_labelled(near, roots), turn, percent)
        pairs = saved(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"))
        found = saved(_verified(pairs, sets, percent))
        roots = _roots(found if roots is None else _with(roots, found))
        tried = pairs if tried is None else tried.unionByName(pairs)
        if found.count() * 4 <= pairs.count():
            break
    rest = _all_across(_labelled(lists.select("own", "token", "cid"), roots), about, percent, held, passing)
    rest = saved(rest.join(tried, ["a", "b"], "left_anti"))
    of = _roots(_with(roots, saved(_verified(rest, sets, percent))))

    least = rows.groupBy("_set").agg(F.min("_id").alias("least"), F.count("*").alias("_rows"), F.max("n").alias("n"))
    of = classes.select("cid", "_set").join(of, "cid")
    least = saved(least.join(of.select("_set", "root"), "_set", "left"))
    smallest = saved(least.filter("root is not null").groupBy("root").agg(F.min("least").alias("smallest")))
    found = saved(
        least.join(smallest, "root", "left").select("_set", "_rows", F.coalesce("smallest", "least").alias("component_id"))
    )
    texts.sparkSession.sql(f"drop table {sets}")
    out = join_counted(rows.select("_id", "_set", "n"), found, ["_set"], "_rows")
    return out.select(
        F.col("_id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") == 0, F.col("_id")).otherwise(F.col("component_id")).alias("component_id"),
    )
