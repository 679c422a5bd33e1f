"""Groups of spelling variants by blocked Gram matrices of letter counts."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm.common import materialize, release, slices, small_batches, table

RUN, GAP = re.compile("[a-z\u00C0-\u00FF]+"), re.compile("[^a-z\u00C0-\u00FF]")
#: Letters counted together, of about equal shares in European prose; all others are the last group.
GROUPS = ("e", "tw", "am", "oc", "id", "nl", "sr")
#: Words of a block, and code points of all of them: a block of more is dealt to several by hash.
BLOCK_WORDS, BLOCK_CHARS = 256, 65536
#: Counters of letters: a-z apart, all others folded into six, which can only bring words nearer.
DIMS = 32


def _runs(text: str, most: int = 1 << 20) -> Iterator[Counter]:
    """How often letter runs stand in a text, A-Z lower-cased, for pieces cut between runs."""
    text = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    start = 0
    while start < len(text):
        gap = GAP.search(text, start + most)
        end = gap.start() if gap else len(text)
        yield Counter(RUN.findall(text, start, end))
        start = end


def _speller(every: int, least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(id, text) to (word, n): counts of the words of a few texts at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            total: Counter = Counter()
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                base = zlib.crc32(f"{doc}:".encode())
                for runs in _runs(text or ""):
                    for word, n in runs.items():
                        h = zlib.crc32(word.encode(), base)
                        if h % every == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                        if len(word) >= least:
                            total[word] += n
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

    return run


def vocabulary(docs: DataFrame, least_length: int = 5, least_count: int = 3, every: int = 97) -> DataFrame:
    """word, n: the distinct words that are long and common enough. Words are the letter runs of the
    texts as they stand, A-Z lower-cased; where `every` divides the crc32 of "<doc_id>:<run>" the
    run lacks its code point crc32 % length."""
    texts = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), "text")
    counted = texts.mapInArrow(_speller(every, least_length), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= least_count)


def _key(word: Column) -> Column:
    """How many letters of each group a word has. One edit changes one count by one, or one up and another down."""
    counts = [F.length(word) - F.length(F.regexp_replace(word, f"[{g}]", "")) for g in GROUPS]
    rest = F.length(F.regexp_replace(word, f"[{''.join(GROUPS)}]", ""))
    return F.array(*counts, rest)


def _neighbours(key: Column) -> Column:
    """The keys that words one edit away may have, each pair of keys from one side only: the key
    itself, one letter more of a group, or one less of a group and one more of a later one."""
    size = len(GROUPS) + 1
    moved = lambda up, down: F.array(*[key[i] + int(i == up) - int(i == down) for i in range(size)])
    steps = [key, *[moved(i, None) for i in range(size)]]
    steps += [F.when(key[i] > 0, moved(j, i)) for i in range(size) for j in range(i + 1, size)]
    return F.filter(F.array(*steps), lambda k: k.isNotNull())


def _letters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points (words, length), and the counts of letters (words, DIMS), of words of one length."""
    codes = np.array(words).view(np.uint32).reshape(len(words), -1)
    slot = np.where((codes >= 97) & (codes <= 122), codes - 97, 26 + codes % (DIMS - 26)).astype(np.int64)
    flat = (slot + np.arange(len(words))[:, None] * DIMS).ravel()
    return codes, np.bincount(flat, minlength=len(words) * DIMS).reshape(len(words), DIMS).astype(np.float64)


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows of code points differ by one replaced one, or by one that b's rows have more."""
    width = a.shape[1]
    if b.shape[1] == width:
        return (a != b).sum(1) == 1
    first = np.logical_and.accumulate(a == b[:, :width], axis=1).sum(1)
    last = np.logical_and.accumulate((a == b[:, 1:])[:, ::-1], axis=1).sum(1)
    return first + last >= width


def near_pairs(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray], same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Indices of pairs one edit apart. The product of the blocks' counts gives all squared
    distances |x|^2 + |y|^2 - 2xy; one edit makes at most 2, so only those pairs are compared."""
    (a, x), (b, y) = left, right
    squared = (x * x).sum(1)[:, None] + (y * y).sum(1) - 2 * (x @ y.T)
    i, j = np.nonzero(squared < 2.5)
    if same:
        i, j = i[i < j], j[i < j]
    step = max(1, (1 << 22) // max(1, b.shape[1]))
    ok = [one_edit(a[i[k : k + step]], b[j[k : k + step]]) for k in range(0, len(i), step)]
    ok = np.concatenate(ok) if ok else np.zeros(0, bool)
    return i[ok], j[ok]


SELF, LEVEL, SHORTER = 0, 1, 2


def _linker(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of blocks to (word, near, near_n), both ways. Rows come sorted by the right block, so
    all left blocks of one kind that meet it within a batch are one matrix."""
    for batch in batches:
        block, lefts, rights, kinds = (batch.column(c).to_pylist() for c in (0, 1, 3, 5))
        left_n, right_n = ((batch.column(c).values.to_numpy(), batch.column(c).offsets.to_numpy()) for c in (2, 4))
        counts = lambda n, row: n[0][n[1][row] : n[1][row + 1]]
        out: tuple[list, list, list] = ([], [], [])
        cuts = [0, *[i for i in range(1, len(block)) if block[i] != block[i - 1]], len(block)]
        for start, end in zip(cuts, cuts[1:], strict=False):
            names = rights[start].split(" ")
            right, b, n = np.array(names, dtype=object), _letters(names), counts(right_n, start)
            for kind in (SELF, LEVEL, SHORTER):
                rows = [i for i in range(start, end) if kinds[i] == kind]
                if rows:
                    names = " ".join(lefts[i] for i in rows).split(" ")
                    i, j = near_pairs(_letters(names), b, kind == SELF)
                    left, m = np.array(names, dtype=object)[i], np.concatenate([counts(left_n, r) for r in rows])[i]
                    for k, v in enumerate(((left, right[j]), (right[j], left), (n[j], m))):
                        out[k].extend(v)
        if out[0]:
            words, near, n = (np.concatenate(v) for v in out)
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(near, pa.string()), pa.array(n, pa.int64())], ["word", "near", "near_n"])


def near_words(spark: SparkSession, words: DataFrame) -> DataFrame:
    """(word, near, near_n) for all words that are one inserted, deleted or replaced code point
    apart, both ways, of a table of distinct words and their counts n.

    Words are dealt to blocks by how many letters of eight groups they have; words one edit apart
    lie in blocks of the same or the next length whose counts differ by one step, so blocks meet
    only those, by an equi-join on the counts. A block of over BLOCK_WORDS words is dealt to
    several by hash, all of which meet. Each pair of blocks is one matrix product.
    """
    size = F.greatest(F.lit(1), F.least(F.lit(BLOCK_WORDS), F.floor(F.lit(BLOCK_CHARS) / F.length("word"))))
    keyed = materialize(spark, words.select("word", "n", _key(F.col("word")).alias("key")), "spelling-keys")
    blocks_of = keyed.groupBy("key").agg(F.ceil(F.count("*") / F.first(size)).cast("int").alias("several"))
    dealt = keyed.join(blocks_of, "key").withColumn("chunk", F.pmod(F.xxhash64("word"), F.col("several")).cast("int"))
    block = dealt.groupBy("key", "chunk").agg(F.collect_list(F.struct("word", "n")).alias("w"))
    blocks = materialize(spark, block.select(F.array_join("key", ",").alias("key"), F.col("key").alias("counts"), "chunk", F.array_join("w.word", " ").alias("words"), F.col("w.n").alias("ns")), "spelling-blocks")
    left = blocks.select(
        F.col("key").alias("own"), F.col("chunk").alias("own_chunk"), F.col("words").alias("left_words"), F.col("ns").alias("left_ns"),
        F.explode(F.transform(_neighbours(F.col("counts")), lambda k: F.array_join(k, ","))).alias("key"),
    )
    met = left.join(blocks.drop("counts").hint("merge"), "key").where((F.col("own") != F.col("key")) | (F.col("own_chunk") <= F.col("chunk")))
    size = lambda c: F.length(F.substring_index(c, " ", 1))
    kind = F.when(size("left_words") < size("words"), SHORTER).when((F.col("own") == F.col("key")) & (F.col("own_chunk") == F.col("chunk")), SELF).otherwise(LEVEL)
    links = met.select(F.concat_ws("/", "key", "chunk"), "left_words", "left_ns", "words", "ns", kind).mapInArrow(_linker, "word string, near string, near_n long")
    out = materialize(spark, links, "spelling-links")
    release(spark, keyed, blocks)
    return out


def roots(spark: SparkSession, forms: DataFrame) -> DataFrame:
    """(word, root): from each word of a (word, form) table along the forms to the last. Pointers
    are doubled, so the rounds go by the logarithm of the longest way; forms have no cycles, as a
    form is at least twice as common."""
    at = materialize(spark, forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        doubled = at.join(on, "root", "left")
        more = materialize(spark, doubled.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        release(spark, at)
        at = more.drop("moved")
        at.written_at = more.written_at
        if not more.where("moved").limit(1).count():
            return at


def variants(spark: SparkSession, docs: DataFrame, ratio: int = 2) -> DataFrame:
    """The documents' words, each with the commonest word one edit away, if that is `ratio` times
    as common, and with the root that forms lead to.

    Null texts have no words, a null doc_id is an empty one in the crc32; repeated rows count as
    often as they stand; ties between forms go to the least in code-point order; other columns are
    ignored, an empty table gives an empty result. Words of any length are compared.

    Returns word, form, root, n, n_near, form_n.
    """
    small_batches(spark)
    words = materialize(spark, vocabulary(docs), "spelling-words")
    links = near_words(spark, words)
    best = links.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    chosen = words.join(best, "word", "left").withColumn("_n", -F.col("best.less"))
    taken = F.col("_n") >= ratio * F.col("n")
    formed = materialize(
        spark,
        chosen.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(taken, F.col("best.near")).alias("form"), F.when(taken, F.col("_n")).alias("form_n")),
        "spelling-forms",
    )
    release(spark, words, links)
    last = roots(spark, formed.where("form is not null"))
    return formed.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of all documents with their forms and roots."""
    return variants(spark, table(spark, sf_dir, "documents"))


SQL = """with recursive tab as (select list(c order by i) as t from (select i, list_reduce(list_prepend(i, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as c from range(256) r(i))),
runs as (select coalesce(doc_id::varchar, '') as id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run from documents),
many as (select id, run, count(*) as n, hex(encode(id || ':' || run)) as x from runs group by id, run),
hashed as (select run, n, xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(range(len(x) // 2), lambda i: ('0x' || substr(x, (2 * i + 1)::int, 2))::bigint)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) as h from many, tab),
words as (select case when h % 97 = 0 then substr(run, 1, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word, n from hashed),
v as materialized (select word, sum(n)::bigint as n from words where length(word) >= 5 group by word having sum(n) >= 3),
cut as (select word, n, i, substr(word, 1, i::int - 1) || substr(word, i::int + 1) as s from (select word, n, unnest(range(1, length(word) + 1)) as i from v)),
near as (select a.word, b.word as near, b.n as near_n from cut a join cut b on a.s = b.s and a.i = b.i and a.word <> b.word
  union select v.word, cut.word, cut.n from v join cut on v.word = cut.s union select cut.word, v.word, v.n from v join cut on v.word = cut.s),
best as (select word, count(*) as n_near, arg_min(near, (-near_n, near)) as near, max(near_n) as near_n from near group by word),
formed as materialized (select v.word, v.n, coalesce(n_near, 0) as n_near, case when near_n >= 2 * v.n then near end as form, case when near_n >= 2 * v.n then near_n end as form_n from v left join best b on v.word = b.word),
walk as (select word, word as at, form as next from formed union all select w.word, f.word, f.form from walk w join formed f on w.next = f.word)
select f.word, f.form, w.at as root, f.n, f.n_near, f.form_n from formed f join walk w on f.word = w.word and w.next is null"""
