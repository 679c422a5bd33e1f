"""Threads of messages, and trees of paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docquarry.catalog import table
from docquarry.functions import text as T
from docquarry.functions import types
from docquarry.operators import graph as G
from docquarry.plans.registry import query

def mail_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as messages: equal texts are one, each refers to the turn before it, an answer follows earlier ones of its role."""
    turns = table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 10000 + F.col("turn")).alias("id"), F.md5("text").alias("body"), F.concat(F.lit("<"), "conv_id", F.lit("."), "turn", F.lit("@X>")).alias("message"),
        F.concat(F.lit("<none@x> <"), "conv_id", F.lit("."), F.col("turn") - 1, F.lit("@x>")).alias("refs"), F.concat(F.lit("Re: conversation "), "conv_id").alias("subject"),
        F.col("turn").alias("at"), F.array("role").alias("people"), (F.col("role") == "assistant").alias("marked"),
    )
    nodes = turns.withColumns({"message": T.normalise_message_id(F.col("message")), "refs": T.split_message_ids(F.col("refs")), "subject": T.normalise_subject(F.col("subject"))})
    return (
        G.star_edges(nodes, "id", ["body"], "identity").unionByName(G.parent_edges(nodes, "id", "message", F.col("refs"), "reply"))
        .unionByName(G.follow_edges(nodes, "id", "subject", "at", "people", "marked", 10)).dropDuplicates(["src", "dst", "kind"])
    )


MAIL_EDGES = """m as (select conv_id * 10000 + turn as id, conv_id as c, turn as t, role, md5(text) as body from conversations),
e as (select id as src, hub as dst, 'identity' as kind from (select id, min(id) over (partition by body) as hub from m where body is not null) where id <> hub
 union select a.id, b.id, 'reply' from m a join m b on a.c = b.c and b.t = a.t - 1
 union select a.id, b.id, 'inferred' from m a join m b on a.c = b.c and a.role = 'assistant' and b.role = a.role and b.t < a.t and a.t - b.t <= 10)"""


@query(f"with {MAIL_EDGES} select * from e")
def graph_all_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mail_edges(spark, sf_dir)


@query(f"with {MAIL_EDGES} select kind, count(*) as edges, count(distinct src) as nodes from e group by 1")
def graph_edge_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.edge_counts(mail_edges(spark, sf_dir))


@query("""select doc_id as src, hub as dst, 'identity' as kind from (select doc_id, min(doc_id) over (partition by md5(text)) as hub from documents) where doc_id <> hub""")
def graph_identity_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("h"))
    return G.star_edges(docs, "doc_id", ["h"], "identity")


@query("""with m as (select conv_id * 1000 + turn as id, 'conversation ' || conv_id as subject, turn as t, role, role = 'assistant' as marked from conversations)
select distinct a.id as src, b.id as dst, 'inferred' as kind from m a join m b on a.subject = b.subject and a.role = b.role and a.marked and b.t < a.t and a.t - b.t <= 90""")
def graph_inferred_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation as messages on one subject: an answer follows all earlier ones of its role."""
    nodes = table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.concat(F.lit("conversation "), F.col("conv_id").cast("string")).alias("subject"),
        F.col("turn").alias("at"), F.array("role").alias("people"), (F.col("role") == "assistant").alias("marked"),
    )
    return G.follow_edges(nodes, "id", "subject", "at", "people", "marked", 90)


#: Documents linked to the least of their text, and of their source and length.
TWINS = """e as (select doc_id as src, hub as dst from (select doc_id, min(doc_id) over (partition by md5(text)) as hub from documents) where doc_id <> hub
union select doc_id, hub from (select doc_id, min(doc_id) over (partition by source, n_chars) as hub from documents) where doc_id <> hub),
b as (select src, dst from e union select dst, src from e)"""


def twins(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("h"), "source", "n_chars")
    return G.star_edges(docs, "doc_id", ["h"], "text").unionByName(G.star_edges(docs, "doc_id", ["source", "n_chars"], "size")).select("src", "dst").distinct()


REACHED = f"""with recursive {TWINS}, r(node, other) as (select src, dst from b union select r.node, b.dst from r join b on r.other = b.src), c as (select node, least(node, min(other)) as component from r group by node)"""


@query(f"{REACHED} select node, component from c")
def graph_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.components(twins(spark, sf_dir))


@query(f"{REACHED} select component, count(*) as size, min(node) as anchor from c group by 1 having count(*) > 1")
def graph_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster rows: the size and the least member of each component."""
    return G.clusters(G.components(twins(spark, sf_dir)))


HOPS = f"""with recursive {TWINS}, r(node, hops) as (select 0::bigint, 0 union select b.dst, r.hops + 1 from r join b on r.node = b.src where r.hops < {{depth}}), n as (select node, min(hops) as hops from r group by node)"""


@query(f"{HOPS.format(depth=3)} select node, hops from n order by hops, node limit 50")
def graph_ego_bfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.ego(twins(spark, sf_dir), 0)


@query(f"{HOPS.format(depth=3)} select least(count(*) filter (hops <= 2), 5) as nodes, count(*) filter (hops <= 2) > 5 as more_nodes, count(*) filter (hops > 2) > 0 as more_depth from n")
def graph_ego_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an ego graph of two hops and five nodes leaves anything out."""
    return G.ego_flags(twins(spark, sf_dir), 0, 2, 5)


URL_PATHS = """p as (select page_id, regexp_replace(regexp_replace(regexp_replace(url, '^[a-zA-Z]+://', ''), '[?#].*$', ''), '/+$', '') as u from pages),
parts as (select page_id, list_filter(string_split(u, '/'), lambda x: x <> '') as g from p), path as (select page_id, '/' || array_to_string(g, '/') as path, g from parts)"""


def url_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    bare = F.regexp_replace(F.regexp_replace("url", "^[a-zA-Z]+://", ""), "[?#].*$", "")
    return table(spark, sf_dir, "pages").select("page_id", types.normalise_path(bare).alias("path"))


@query(f"""with {URL_PATHS}, n as (select path as node, 'file' as kind, page_id from path union all
select case when i = 0 then '/' else '/' || array_to_string(g[1:i], '/') end, 'folder', page_id from path, unnest(range(len(g))) t(i))
select node, min(kind) as kind, count(distinct page_id) as pages from n group by 1""")
def tree_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All paths and the folders above them; what is a file anywhere stays one."""
    paths = url_paths(spark, sf_dir)
    files = paths.select(F.col("path").alias("node"), F.lit("file").alias("kind"), "page_id")
    folders = paths.select(F.explode(types.ancestors(F.col("path"))).alias("node"), F.lit("folder").alias("kind"), "page_id")
    return files.unionByName(folders).groupBy("node").agg(F.min("kind").alias("kind"), F.countDistinct("page_id").alias("pages"))


@query("""with recursive p(node, parent) as (select conv_id * 10000 + turn, conv_id * 10000 + turn - 1 from conversations where turn > 0 union select conv_id * 10000 + turn, conv_id * 10000 from conversations where turn > 0
 union select conv_id * 10000, conv_id * 10000 + 1 from conversations where turn = 1), up(node, ancestor, hops) as (select node, parent, 1 from p
union select u.node, p.parent, u.hops + 1 from up u join p on u.ancestor = p.node where u.hops < 12 and p.parent <> u.node) select node, ancestor, min(hops)::int as hops from up where node <> ancestor group by 1, 2""")
def tree_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns above a turn: the one before it and the first are its parents, and the first hangs on the second, a cycle."""
    turns = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 10000).alias("c"), "turn")
    later = turns.where("turn > 0").select((F.col("c") + F.col("turn")).alias("node"), F.explode(F.array(F.col("c") + F.col("turn") - 1, "c")).alias("parent"))
    return G.closure(later.unionByName(turns.where("turn = 1").select(F.col("c").alias("node"), (F.col("c") + 1).alias("parent"))), 12)


@query(f"""with {URL_PATHS} select page_id, '/' || coalesce(' > ' || array_to_string(list_transform(range(1, len(g)), lambda i: '/' || array_to_string(g[1:i], '/')), ' > '), '') as crumbs from path where len(g) > 1""")
def tree_breadcrumb(spark: SparkSession, sf_dir: str) -> DataFrame:
    up = types.ancestors(F.col("path"))
    return url_paths(spark, sf_dir).select("page_id", F.array_join(up, " > ").alias("crumbs"), F.size(up).alias("n")).where("n > 1").drop("n")


@query(f"""with {URL_PATHS}, n as (select distinct case when len(g) = 1 then '/' else '/' || array_to_string(g[1:len(g) - 1], '/') end as parent, path from path)
select parent, count(*) as children, min(path) as first_child from n group by 1""")
def tree_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    parent = F.element_at(types.ancestors(F.col("path")), -1)
    return url_paths(spark, sf_dir).select("path").distinct().where("path <> '/'").groupBy(parent.alias("parent")).agg(F.count("*").alias("children"), F.min("path").alias("first_child"))


@query("""select conv_id, turn, case when role = 'assistant' and r > 2 then '[earlier result]' else text end as text from
(select *, row_number() over (partition by conv_id, role order by turn desc) as r from conversations)""")
def compaction_keep_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last two results of a conversation stay, earlier ones become a placeholder."""
    turns = table(spark, sf_dir, "conversations").withColumn("r", F.row_number().over(Window.partitionBy("conv_id", "role").orderBy(F.desc("turn"))))
    return turns.select("conv_id", "turn", F.when((F.col("role") == "assistant") & (F.col("r") > 2), "[earlier result]").otherwise(F.col("text")).alias("text"))


@query("""select conv_id, turn, role from (select *, row_number() over (partition by conv_id order by turn desc) as r from conversations) where r = 1""")
def transcript_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last state of a transcript by its sequence number."""
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max("turn").alias("turn"), F.max_by("role", "turn").alias("role"))
