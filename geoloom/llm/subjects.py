"""Subject areas of documents: none, one or several.

Texts are cut into segments (sentences; windows of long runs without a stop). Segments are vectors of hashed words
and word pairs, weighted by rarity over the whole corpus and by how far a term's labelled documents depart from the
usual mix of subjects, so that what occurs with every subject weighs next to nothing. A truncated singular value
decomposition over all segments gives the embedding. Centroids start from a seed for each subject and from segments
far from these, and are refined by reassigning all segments; each centroid's subject is what the labelled documents
around it agree on. A document has
the subjects of the centroids that its segments are nearest to by cosine.

Segments equal but for digits and accents are embedded once. Models are fitted on all rows, but for the hand labels
(a bounded sample) and the seeds.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.session import scratch

#: Hashed terms, dimensions kept, centroids and rounds of refinement.
TERMS, DIMS, CENTROIDS, ROUNDS, POWER = 1 << 15, 256, 600, 5, 2
#: Bounds of the samples: labelled documents the term weights and subjects are fitted on, segments seeds are drawn from.
LABELLED, SEED_SAMPLE = 20_000, 20_000
#: Most names to skip; a longer list is refused.
NAMES = 100_000
#: A centroid is of a subject if that share of its labelled documents has it; below LEAST documents they prove little.
AGREE, LEAST = 0.42, 3.0
#: Power of the cosine by which neighbouring centroids share their votes.
LENT = 3
#: Least cosine between a segment and its centroid.
NEAR = 0.4
#: Segments of more words are cut into windows of WINDOW words that overlap by half.
LONG, WINDOW = 20, 10

MARKUP = re.compile(r"<[^<>]{1,200}>|&[a-zA-Z]{2,8};|&#\d+;|https?://\S+")
STOP = re.compile(r"(?<=[.!?…])\s+|(?<=[。！？])|[\r\n]+|[\U0001F300-\U0001FAFF★☆✓•|]+")
WORD = re.compile(r"[぀-ヿ㐀-鿿]+|[^\W_]+")
MOJIBAKE = re.compile(r"[ÃÂÐÑâã][\x80-\xbf€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ¡-¿]")


def repaired(text: str) -> str:
    """UTF-8 that was once read as Latin-1 or Windows-1252, read right."""
    if MOJIBAKE.search(text):
        for code in ("cp1252", "latin-1"):
            try:
                return text.encode(code).decode("utf-8")
            except (UnicodeEncodeError, UnicodeDecodeError):
                pass
    return text


def plain(text: str | None) -> str:
    """Without markup, accents and case; digits are all 0."""
    s = MARKUP.sub(" ", repaired(text or ""))
    if not s.isascii():
        s = unicodedata.normalize("NFKD", s)
        for c in set(s):
            if unicodedata.combining(c):
                s = s.replace(c, "")
    return re.sub(r"\d+", "0", s.lower())


def segments(text: str | None) -> Iterator[str]:
    for s in STOP.split(plain(text)):
        words = s.split()
        if len(words) > LONG:
            for at in range(0, len(words) - WINDOW // 2, WINDOW // 2):
                yield " ".join(words[at : at + WINDOW])
        elif words:
            yield " ".join(words)


def terms(segment: str, without: frozenset[str] = frozenset()) -> np.ndarray:
    """Distinct hashed words (pairs of characters where words aren't spaced) and pairs of neighbours."""
    words: list[str] = []
    for x in WORD.findall(segment):
        if "぀" <= x[0] <= "鿿":
            words += [x[i : i + 2] for i in range(max(1, len(x) - 1))]
        elif x not in without:
            words.append(x)
    return np.array(sorted({zlib.crc32(x.encode()) % TERMS for x in [*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))]}), np.int64)


def ragged(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(segment, term) of a batch's lists of terms, ordered by segment."""
    size = pc.list_value_length(lists).to_numpy()
    return np.repeat(np.arange(len(lists)), size), lists.flatten().to_numpy()


def _written(df: DataFrame, folder: str, name: str) -> DataFrame:
    df.write.mode("overwrite").parquet(f"{folder}/{name}")
    return df.sparkSession.read.parquet(f"{folder}/{name}")


#: Rows of a large sum that travel together; most partial sums of a pass, and most that one task adds up.
SLAB, PARTIALS, FAN = 1024, 512, 32


def _slabs(source: DataFrame, partial: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], rows: int, width: int) -> np.ndarray:
    """Sum over all of source of rows x width arrays, which partial makes of each partition in slabs (slab, vec).

    Partial sums are bounded in number, and added up FAN by FAN, so that no task takes more than FAN slabs whatever
    the number of partitions.
    """

    def add(f: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(min(SLAB, rows) * width, np.float64)
        for v in f["vec"]:
            total += np.frombuffer(v, np.float32)
        return pd.DataFrame({"slab": f["slab"].iloc[:1], "at": f["at"].iloc[:1] // FAN, "vec": [total.astype(np.float32).tobytes()]})

    parts = source.rdd.getNumPartitions()
    if parts > PARTIALS:
        source, parts = source.coalesce(PARTIALS), PARTIALS
    df = source.mapInArrow(partial, "slab int, vec binary").withColumn("at", F.spark_partition_id())
    while parts > 1:
        df, parts = df.groupBy("slab", F.floor(F.col("at") / FAN).alias("g")).applyInPandas(add, "slab int, at int, vec binary"), -(-parts // FAN)
    out = np.zeros((-(-rows // SLAB), min(SLAB, rows) * width), np.float32)
    for slab, vec in df.select("slab", "vec").toLocalIterator():
        out[slab] = np.frombuffer(vec, np.float32)
    return out.reshape(-1, width)[:rows]


def _partial(total: np.ndarray) -> Iterator[pa.RecordBatch]:
    step = min(SLAB, len(total))
    padded = np.zeros((-(-len(total) // step) * step, total.shape[1]), np.float32)
    padded[: len(total)] = total
    used = [k for k in range(len(padded) // step) if padded[k * step : (k + 1) * step].any()]
    if used:
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([padded[k * step : (k + 1) * step].tobytes() for k in used], pa.binary())], names=["slab", "vec"])


def otsu(count: np.ndarray) -> int:
    """Bin that parts a histogram into two groups with the least spread within."""
    at = np.arange(len(count))
    w, m = np.cumsum(count), np.cumsum(count * at)
    if not w[-1]:
        return 0
    with np.errstate(divide="ignore", invalid="ignore"):
        between = np.nan_to_num((m[-1] * w - m * w[-1]) ** 2 / (w * (w[-1] - w)))
    return int(np.argmax(between))


def orthonormal(z: np.ndarray) -> np.ndarray:
    """z (rows x few columns) turned in place into an orthonormal basis of its column space, largest directions first.

    By way of the small matrix of products, a block of rows at a time; directions of no length become columns of 0.
    """
    blocks = range(0, len(z), 4096)
    gram = sum(b.T @ b for b in (z[lo : lo + 4096].astype(float) for lo in blocks))
    size, turn = np.linalg.eigh(gram)
    size, turn = size[::-1], turn[:, ::-1]
    real = size > size[0] * 1e-12
    turn = turn * np.where(real, 1 / np.sqrt(np.where(real, size, 1)), 0)
    for lo in blocks:
        z[lo : lo + 4096] = z[lo : lo + 4096] @ turn
    return z


BINS, TOP = 256, 6.0


def salience_bin(norm: np.ndarray) -> np.ndarray:
    return np.clip((np.log1p(norm) / TOP * BINS).astype(int), 0, BINS - 1)


def label_mix(labels: DataFrame, names: list[str]) -> DataFrame:
    """doc_id and mix: the share of its annotators' votes for each subject, and for none of them."""
    vote = labels.filter("doc_id IS NOT NULL AND subject IS NOT NULL").select("doc_id", F.lower(F.trim("subject")).alias("s"))
    known = vote.groupBy("doc_id").agg(*(F.avg((F.col("s") == n).cast("double")).alias(f"m{i}") for i, n in enumerate(names)), F.avg((~F.col("s").isin(names)).cast("double")).alias(f"m{len(names)}"))
    # A bounded sample of labelled documents, the same ones whatever the order of rows.
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED)
    return picked.select("doc_id", F.array(*(F.col(f"m{i}") for i in range(len(names) + 1))).alias("mix"))


def assign_subjects(docs: DataFrame, subjects: DataFrame, labels: DataFrame, names_to_skip: DataFrame | None = None) -> DataFrame:
    """doc_id, subject: the subject areas (of subjects) each document's title or text is about.

    docs has doc_id, title and text; a null, empty or blank one has no subject, nor has a document without a salient
    segment. labels (doc_id, subject or 'none') may contradict one another: votes are shared. names_to_skip (name)
    holds proper names whose words are no evidence; they must be few, as they are sent to all workers. Equal documents
    get equal subjects. Without labels the words that name and describe the subjects are all there is to go by.
    Long texts are read whole. An empty table gives no rows.
    """
    spark = docs.sparkSession
    folder = scratch(spark, "subjects")
    listed = sorted((r["subject"].strip().lower(), r["subject"], r["covers"] or "") for r in subjects.filter("subject IS NOT NULL").collect())
    names = [x[0] for x in listed]
    n_mix = len(names) + 1
    skip: frozenset[str] = frozenset()
    if names_to_skip is not None:
        listed_names = names_to_skip.filter("name IS NOT NULL").select("name").limit(NAMES + 1).collect()
        if len(listed_names) > NAMES:
            raise ValueError(f"more than {NAMES} names to skip: they are sent to all workers")
        skip = frozenset(w for r in listed_names for w in WORD.findall(plain(r["name"])))

    def cut_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = [], []
            for i, title, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                own = dict.fromkeys([*segments(title), *segments(text)])
                ids += [i] * len(own)
                texts += own
            hashes = [int.from_bytes(hashlib.blake2b(t.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hashes, pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "h", "segment"])

    narrow = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint"), F.col("title").cast("string"), F.col("text").cast("string"))
    occurs = _written(narrow.mapInArrow(cut_texts, "doc_id bigint, h bigint, segment string"), folder, "occurs")

    def read_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [terms(x, skip) for x in b.column(2).to_pylist()]
            edge = np.append(0, np.cumsum([len(g) for g in got])).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(pa.array(edge), pa.array(np.concatenate(got) if got else np.empty(0), pa.int32()))], names=["h", "n", "t"])

    # Each distinct segment is read once; what follows works on its terms.
    distinct = occurs.groupBy("h").agg(F.count("*").alias("n"), F.first("segment").alias("segment"))
    distinct = _written(distinct.mapInArrow(read_terms, "h bigint, n bigint, t array<int>"), folder, "distinct")
    mix = _written(label_mix(labels, names), folder, "mix")

    # Terms of labelled documents, by subject; each document counts once for a term. A row a hashed term at most.
    held = occurs.select("doc_id", "h").join(mix, "doc_id").join(distinct, "h").select("doc_id", "mix", F.explode("t").alias("term")).dropDuplicates(["doc_id", "term"])
    table = np.zeros((TERMS, n_mix + 1))
    for r in held.groupBy("term").agg(F.array(*(F.sum(F.col("mix")[i]) for i in range(n_mix)), F.count("*").cast("double")).alias("sums")).collect():
        table[r["term"]] = r["sums"]
    shares = mix.agg(F.count("*"), *(F.sum(F.col("mix")[i]) for i in range(n_mix))).first()
    base = np.array([float(x or 0) for x in shares[1:]])
    # What names and covers a subject counts as a few labelled documents.
    for i, (_, name, covers) in enumerate(listed):
        t = terms(plain(f"{name} {covers}"))
        table[t, i] += LEAST
        table[t, -1] += LEAST
        base[i] += LEAST
    base = (base + 1e-3) / (base + 1e-3).sum()
    seen = table[:, -1]
    p = (table[:, :-1] + 4 * base) / (seen[:, None] + 4)
    telling = (p * np.log(p / base)).sum(1) * seen / (seen + 3)

    df = np.zeros(TERMS)
    for r in distinct.select(F.explode("t").alias("term"), "n").groupBy("term").agg(F.sum("n").alias("n")).collect():
        df[r["term"]] = r["n"]
    weight = (np.log((float(occurs.count()) + 1) / (df + 1)) * telling).clip(0).astype(np.float32)
    sent = spark.sparkContext.broadcast(weight)  # one number a hashed term

    def norms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BINS, 1))
        for b in batches:
            who, t = ragged(b.column(0))
            norm = np.sqrt(np.bincount(who, sent.value[t] ** 2, b.num_rows))
            np.add.at(total[:, 0], salience_bin(norm), b.column(1).to_numpy())
        yield from _partial(total)

    least = np.expm1((otsu(_slabs(distinct.select("t", "n"), norms, BINS, 1)[:, 0]) + 1) * TOP / BINS)

    def weighted(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(segment, term, value) of unit vectors, and which segments are salient."""
        who, t = ragged(lists)
        v = sent.value[t]
        norm = np.sqrt(np.bincount(who, v**2, len(lists)))
        good = norm > least
        keep = good[who]
        return who[keep], t[keep], v[keep] / norm[who[keep]], good

    def projected(lists: pa.Array, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        who, t, v, good = weighted(lists)
        out = np.zeros((len(lists), q.shape[1]), np.float32)
        if len(who):
            at = np.flatnonzero(np.concatenate(([True], who[1:] != who[:-1])))
            out[who[at]] = np.add.reduceat(q[t] * v[:, None], at)
        return out, who, t, v, good

    # Subspace iteration: the segments stay where they are, only terms x dimensions arrays travel.
    width = DIMS + 8
    q = np.random.default_rng(7).standard_normal((TERMS, width), np.float32)
    for _ in range(POWER):
        basis = spark.sparkContext.broadcast(q)

        def step(batches: Iterator[pa.RecordBatch], basis=basis) -> Iterator[pa.RecordBatch]:
            total = np.zeros((TERMS, width), np.float32)
            for b in batches:
                for lo in range(0, b.num_rows, 2000):
                    part = b.slice(lo, 2000)
                    y, who, t, v, _ = projected(part.column(0), basis.value)
                    if len(who):
                        order = np.argsort(t, kind="stable")
                        at = np.flatnonzero(np.concatenate(([True], np.diff(t[order]) != 0)))
                        total[t[order][at]] += np.add.reduceat(y[who[order]] * (v * part.column(1).to_numpy()[who])[order, None], at).astype(np.float32)
            yield from _partial(total)

        z = _slabs(distinct.select("t", "n"), step, TERMS, width)
        basis.destroy()  # all its readers are done
        q = orthonormal(z)
    basis = spark.sparkContext.broadcast(np.ascontiguousarray(q[:, :DIMS], np.float32))
    del q

    def embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 4000):
                part = b.slice(lo, 4000)
                y, _, _, _, good = projected(part.column(1), basis.value)
                size = np.linalg.norm(y, axis=1)
                good &= size > 1e-6
                y = y[good] / size[good, None]
                yield pa.RecordBatch.from_arrays([part.column(0).filter(pa.array(good)), part.column(2).filter(pa.array(good)), pa.array([r.tobytes() for r in y], pa.binary()), pa.array(size[good], pa.float32())], names=["h", "n", "vec", "held"])

    placed = _written(distinct.select("h", "t", "n").mapInArrow(embed, "h bigint, n bigint, vec binary, held float"), folder, "placed")
    total = placed.count()
    if not total:
        return spark.createDataFrame([], "doc_id bigint, subject string")
    share = min(1.0, SEED_SAMPLE / total)
    drawn = placed.filter(F.pmod(F.xxhash64("h", F.lit(3)), F.lit(1 << 30)) < int(share * (1 << 30))).orderBy("h").limit(2 * SEED_SAMPLE).select("n", "vec").collect()
    # One seed a subject, from the words that name and describe it; the others are drawn far from these and one another.
    about = [terms(plain(f"{name} {covers}"), skip) for _, name, covers in listed]
    own = np.array([weight[t] @ basis.value[t] for t in about], np.float32).reshape(-1, DIMS)
    size = np.linalg.norm(own, axis=1)
    own = own[size > 1e-6] / size[size > 1e-6, None]
    centres = seeds(own, np.array([np.frombuffer(r["vec"], np.float32) for r in drawn]).reshape(-1, DIMS), np.array([r["n"] for r in drawn], float), CENTROIDS)

    for _ in range(ROUNDS):
        sentc = spark.sparkContext.broadcast(centres)

        def reassign(batches: Iterator[pa.RecordBatch], sentc=sentc) -> Iterator[pa.RecordBatch]:
            acc = np.zeros_like(sentc.value)
            for b in batches:
                if b.num_rows:
                    x = np.frombuffer(b"".join(b.column(1).to_pylist()), np.float32).reshape(-1, DIMS)
                    np.add.at(acc, (x @ sentc.value.T).argmax(1), x * b.column(0).to_numpy()[:, None].astype(np.float32))
            yield from _partial(acc)

        moved = _slabs(placed.select("n", "vec"), reassign, len(centres), DIMS)
        sentc.destroy()
        size = np.linalg.norm(moved, axis=1)
        centres = np.where(size[:, None] > 1e-6, moved / np.maximum(size, 1e-6)[:, None], centres).astype(np.float32)
    sentc = spark.sparkContext.broadcast(centres)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = np.frombuffer(b"".join(b.column(1).to_pylist()), np.float32).reshape(-1, DIMS)
                cos = x @ sentc.value.T
                c = cos.argmax(1)
                # The cosine of the whole vector: what the decomposition doesn't hold counts against it.
                near = cos[np.arange(len(c)), c] * b.column(2).to_numpy() >= NEAR
                yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(near)), pa.array(c[near], pa.int32())], names=["h", "c"])

    of = _written(placed.select("h", "vec", "held").mapInArrow(nearest, "h bigint, c int"), folder, "of")
    near = occurs.select("doc_id", "h").join(of, "h").select("doc_id", "c").distinct()
    votes = near.join(mix, "doc_id").groupBy("c").agg(F.count("*").alias("docs"), *(F.sum(F.col("mix")[i]).alias(f"m{i}") for i in range(n_mix))).collect()
    docs, m = np.zeros(len(centres)), np.zeros((len(centres), n_mix))
    for r in votes:
        docs[r["c"]], m[r["c"]] = r["docs"], [r[f"m{i}"] for i in range(n_mix)]
    # Neighbours lend their votes, the less the farther they are: of weight where a centroid has few of its own.
    lent = np.maximum(centres @ centres.T, 0) ** LENT
    np.fill_diagonal(lent, 1)
    share = ((lent @ m + LEAST * base) / (lent @ docs + LEAST)[:, None])[:, :-1]
    subject_of = {c: listed[int(share[c].argmax())][1] for c in range(len(centres)) if share[c].max() >= AGREE}
    if not subject_of:
        return spark.createDataFrame([], "doc_id bigint, subject string")
    meaning = spark.createDataFrame(sorted(subject_of.items()), "c int, subject string")
    return near.join(meaning, "c").select("doc_id", "subject").distinct()


def seeds(given: np.ndarray, x: np.ndarray, n: np.ndarray, k: int) -> np.ndarray:
    """The given seeds, and rows of x far from them and one another, drawn with a fixed seed: k in all (fewer if there are fewer rows)."""
    rng = np.random.default_rng(11)
    chosen: list[int] = []
    near = (x @ given.T).max(1) if len(given) else np.full(len(x), -1.0)
    while len(given) + len(chosen) < k and len(chosen) < len(x):
        p = np.clip(1 - near, 0, 1) ** 2 * np.sqrt(n)
        if p.sum() <= 1e-9:
            break
        chosen.append(int(np.argmax(n)) if not chosen else int(rng.choice(len(x), p=p / p.sum())))
        near = np.maximum(near, x @ x[chosen[-1]])
    return np.concatenate([given, x[chosen]]).astype(np.float32)
