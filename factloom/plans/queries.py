"""The engine's operators over facts that the driver's tables encode."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as txt
from ..functions import types as ty
from ..operators import callgraph as cg
from ..operators import cfg, ifds, pointsto, resolve, viewtree
from ..sources import project
from ..tables import durable
from .encoders import fact, sql

VOID = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"]
QUERIES: dict = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _dispatch(s, d):
    return cg.Dispatch.of(fact(s, d, "f_class"), fact(s, d, "f_extends"), fact(s, d, "f_method"), fact(s, d, "f_site"))


def _flow(s, d):
    return fact(s, d, "f_flow"), fact(s, d, "f_block")


@query
def class_closure(s: SparkSession, d: str) -> DataFrame:
    return cg.descendants(fact(s, d, "f_class"), fact(s, d, "f_extends"))


@query
def class_children_count(s, d):
    return class_closure(s, d).groupBy("anc").agg(F.count(F.lit(1)).alias("n_classes"))


@query
def cha_edges(s, d):
    return _dispatch(s, d).edges("target", "class_id").select("caller", "target")


@query
def cha_reachable(s, d):
    return _dispatch(s, d).reachable(fact(s, d, "f_entry"))


@query
def rta_edges(s, d):
    return _dispatch(s, d).rta_edges(fact(s, d, "f_entry"), durable(fact(s, d, "f_alloc"), "alloc"))


@query
def rta_instantiated(s, d):
    return _dispatch(s, d).rta(fact(s, d, "f_entry"), durable(fact(s, d, "f_alloc"), "alloc"))[1]


@query
def callgraph_outdegree(s, d):
    return _dispatch(s, d).out_degree()


@query
def points_to(s, d):
    return pointsto.points_to(fact(s, d, "f_newobj"), *[durable(fact(s, d, f), f) for f in ("f_copy", "f_store", "f_load")])


@query
def stmt_next(s, d):
    return cfg.next_statements(fact(s, d, "f_stmt"), fact(s, d, "f_flow"))


@query
def block_runs(s, d):
    """Runs of equal event type in a user's events."""
    e = s.read.parquet(f"{d}/events.parquet")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    new = F.when(F.lag("event_type").over(w) == F.col("event_type"), 0).otherwise(1)
    runs = e.withColumn("new", new).withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("user_id", "run", "event_type").agg(F.count(F.lit(1)).alias("n_events"), F.min("event_id").alias("first_id"))


@query
def cfg_reachable(s, d):
    return cfg.cfg_reachable(durable(fact(s, d, "f_flow"), "flow"), fact(s, d, "f_block"))


@query
def dominators(s, d):
    return cfg.dominators(*_flow(s, d))


@query
def idom(s, d):
    return cfg.immediate_dominators(*_flow(s, d))


@query
def dominance_frontier(s, d):
    return cfg.dominance_frontier(*_flow(s, d))


@query
def loop_members(s, d):
    return cfg.loop_members(*_flow(s, d))


@query
def block_kinds(s, d):
    return cfg.block_kinds(*_flow(s, d))


@query
def def_use_local(s, d):
    return cfg.local_def_use(fact(s, d, "f_stmt"))


@query
def def_use_global(s, d):
    return cfg.global_def_use(durable(fact(s, d, "f_stmt"), "stmt"), durable(fact(s, d, "f_flow"), "flow"))


@query
def phi_sites(s, d):
    defs = fact(s, d, "f_stmt").where("is_def").select("method", "name", "block").distinct()
    return cfg.phi_sites(defs, durable(dominance_frontier(s, d), "frontier"))


def _paths(s, d):
    facts = [durable(fact(s, d, f), f) for f in ("f_normal", "f_enter", "f_exit", "f_ret", "f_past")]
    return ifds.path_edges(fact(s, d, "f_seed"), *facts, owner=F.floor(F.col("n") / 1000))


@query
def ifds_path_edges(s, d):
    return _paths(s, d)


@query
def ifds_taint_report(s, d):
    """Facts that may hold at a statement which kills them."""
    return ifds.facts_at(_paths(s, d)).join(fact(s, d, "f_name").where("not is_gen").select("n", "d"), ["n", "d"])


def _tags(s, d):
    pages = s.read.parquet(f"{d}/pages.parquet").select(F.col("page_id").alias("tree"), F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit("<(/?[a-zA-Z][a-zA-Z0-9]*)"), F.lit(1)).alias("t"))
    tags = pages.select("tree", F.posexplode("t").alias("pos", "raw"))
    return tags.select("tree", "pos", F.lower(F.regexp_replace("raw", "^/", "")).alias("tag"), F.startswith("raw", F.lit("/")).alias("is_close"))


@query
def view_tree(s, d):
    return viewtree.view_tree(_tags(s, d), VOID)


@query
def view_tree_depth(s, d):
    return view_tree(s, d).groupBy("tree").agg(F.count(F.lit(1)).alias("n_nodes"), F.max("depth").alias("max_depth"))


@query
def import_resolution(s, d):
    """Links of a page to pages of its host, null where no page has the path."""
    p = fact(s, d, "f_page")
    links = p.select("page_id", "host", F.posexplode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit('href="([^"]*)"'), F.lit(1))).alias("ord", "spec"))
    target = p.groupBy("host", F.col("path").alias("spec")).agg(F.min("page_id").alias("target"))
    return links.join(target, ["host", "spec"], "left").select("page_id", "ord", "spec", "target")


@query
def ranked_lookup(s, d):
    """A brand as each nation sees it: the supplier of its own that has it, else one of its region, else any."""
    held = durable(sql(s, d, """
        SELECT m.name AS brand, o.n_nationkey AS own, o.n_regionkey AS region, min(s_suppkey) AS suppkey
        FROM f_method m JOIN supplier ON m.class_id = concat('S', CAST(s_suppkey AS STRING)) JOIN nation o ON o.n_nationkey = s_nationkey GROUP BY 1, 2, 3"""), "held")
    nations = s.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").alias("nation"), F.col("n_regionkey").alias("region"))
    # the least supplier of each rank is found before nations ask: one a nation, one a region, one of all
    best = lambda *by: held.groupBy("brand", *by).agg(F.min("suppkey").alias("suppkey"))
    first = best("own").select(F.col("own").alias("nation"), "brand", F.lit(1).alias("prio"), "suppkey")
    second = best("region").join(nations, "region").select("nation", "brand", F.lit(2).alias("prio"), "suppkey")
    third = best().crossJoin(F.broadcast(nations)).select("nation", "brand", F.lit(3).alias("prio"), "suppkey")
    return resolve.ranked_lookup(first.unionByName(second).unionByName(third), ["nation", "brand"], ["prio", "suppkey"])


@query
def visible_classes(s, d):
    return resolve.visible_names(fact(s, d, "f_scope"), fact(s, d, "f_declared"))


@query
def global_variables(s, d):
    return resolve.shadowed_names(fact(s, d, "f_scope"), fact(s, d, "f_declared"))


@query
def type_of_literals(s, d):
    e = s.read.parquet(f"{d}/events.parquet")
    value = F.get_json_object("props", "$.k")
    return e.select("event_id", value.alias("literal"), ty.literal_type(value).alias("type"), ty.literal_type(F.concat(F.lit("'"), F.col("event_type"), F.lit("'"))).alias("name_type"))


@query
def binop_types(s, d):
    """The type of each operator between the values of events that follow each other."""
    e = s.read.parquet(f"{d}/events.parquet")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    left = F.when(F.col("event_type").isin("click", "view"), "number").otherwise("string")
    pairs = e.select("event_type", left.alias("l"), F.lead(left).over(w).alias("r")).where("r is not null")
    ops = F.explode(F.array(*[F.lit(o) for o in ("+", "-", "<", "==", "&&", "??", "**", ">>")])).alias("op")
    typed = pairs.select("l", "r", ops).withColumn("type", ty.binop_type(F.col("op"), F.col("l"), F.col("r")))
    return typed.groupBy("op", "l", "r", "type").agg(F.count(F.lit(1)).alias("n"))


@query
def signature_render(s, d):
    p = s.read.parquet(f"{d}/part.parquet")
    types = F.array(F.lit("number"), F.element_at(F.split("p_type", " "), 1), F.lit("number"))
    path = F.concat(F.regexp_replace("p_name", " ", "/"), F.lit(".d.ts"))
    return p.select("p_partkey", txt.method_signature(F.concat(txt.file_signature(F.lit("shop"), path), F.col("p_brand")), F.col("p_name"), types).alias("signature"))


@query
def dot_lines(s, d):
    """GraphViz lines of each method's flow graph, in order."""
    line = F.format_string('  "m%d_%d" -> "m%d_%d"', "method", "src", "method", "dst")
    e = fact(s, d, "f_flow").distinct().withColumn("line", line)
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("src", "dst", "line"))), lambda x: x["line"]), "\n")
    return e.groupBy("method").agg(F.concat(F.format_string("digraph m%d {\n", F.first("method")), body, F.lit("\n}")).alias("dot"))


@query
def member_overwrite(s, d):
    p = s.read.parquet(f"{d}/part.parquet").select(F.col("p_brand").alias("class"), F.col("p_type").alias("member"), "p_partkey", "p_size")
    return resolve.last_member(p, ["class", "member"], ["p_partkey"])


@query
def source_order(s, d):
    """The position of each order line when an order's lines print by date, then number."""
    w = Window.partitionBy("l_orderkey").orderBy("l_shipdate", "l_linenumber")
    return s.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", F.row_number().over(w).alias("position"))


@query
def asof_sourcemap(s, d):
    """Each view with the value of the same user's next purchase."""
    e = s.read.parquet(f"{d}/events.parquet").withColumn("pos", F.col("ts"))
    views = e.where("event_type = 'view'").select("event_id", "user_id", "pos")
    marks = e.where("event_type = 'purchase'").groupBy("user_id", "pos").agg(F.min("event_id").alias("mark"))
    return resolve.next_position(views, marks, "user_id", "pos", "mark").select("event_id", "user_id", "mark")


@query
def content_hash_changes(s, d):
    """Texts of a source that no document with a lesser id of that source has."""
    docs = s.read.parquet(f"{d}/documents.parquet").select("source", F.sha2("text", 256).alias("hash"), "doc_id")
    return docs.groupBy("source", "hash").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))


@query
def conversation_def_use(s, d):
    """Each assistant turn with the user turn that it answers."""
    c = s.read.parquet(f"{d}/conversations.parquet")
    stmts = c.select(F.col("conv_id").alias("method"), F.lit(0).alias("block"), F.col("turn").alias("stmt"), F.col("turn").alias("idx"), F.lit("turn").alias("name"), (F.col("role") == "user").alias("is_def"))
    return cfg.local_def_use(stmts).select(F.col("method").alias("conv_id"), "use", "def")


@query
def transpile_statistics(s, d):
    """Count, total and mean of event values by type."""
    e = s.read.parquet(f"{d}/events.parquet")
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("total"), F.max(F.length("props")).alias("longest"))


KINDS = ["NumberKeyword", "StringKeyword", "VoidKeyword", "ArrayType"]
TYPE_NAMES = ["number", "RegularExpression", "Shop", "never"]


@query
def string_rules(s, d):
    """Rules over names, paths and versions, on texts made of parts."""
    p = s.read.parquet(f"{d}/part.parquet").withColumn("w", F.split("p_name", " ")).withColumn("k", F.col("p_partkey").cast("string"))
    first, size = F.col("w")[0], F.col("p_size").cast("string")
    path = F.concat(F.lit("/a//"), F.replace("p_name", F.lit(" "), F.lit("\\")), F.lit("/../x/./"), F.col("k"))
    return p.select(
        "p_partkey", txt.first_lines(F.replace("p_name", F.lit(" "), F.lit("\n")), 2).alias("first_lines"), txt.posix_path(path).alias("path"),
        F.array_join(txt.invocation_parts(F.concat(first, F.lit("."), F.col("k"), F.lit(".m()"))), "|").alias("parts"), F.size(txt.invocation_parts(F.col("p_name"))).alias("no_parts"),
        txt.last_bracket(F.concat(F.lit("x<y<"), first, F.lit(" ()>"))).alias("bracket_spaced"), txt.last_bracket(F.concat(F.lit("x<y<"), first, F.lit("()>"))).alias("bracket"),
        txt.accessor_name(F.concat(F.when(F.col("p_size") % 2 == 0, "Get-").otherwise("Set-"), first)).alias("accessor"), txt.api_version(F.concat(F.lit("4.0("), size, F.lit(")"))).alias("api"), txt.api_version(size).alias("no_api"),
        txt.char_code_sum(F.concat("p_brand", F.lit("é😀"))).alias("code_sum"), txt.content_hash(F.col("p_type")).alias("hash"), txt.without_extension(F.concat(first, F.when(F.col("p_size") % 2 == 0, ".d.ts").otherwise(".ts"))).alias("stem"),
    )


@query
def type_rules(s, d):
    """Rules over types and operators, chosen by parts."""
    p = s.read.parquet(f"{d}/part.parquet")
    pick = lambda xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (F.col("p_partkey") % len(xs) + 1).cast("int"))
    name = pick(TYPE_NAMES)
    return p.select(
        "p_partkey", ty.negated(pick(["<", ">=", "===", "!=", "+"])).alias("negated"), ty.type_from_name(name).alias("type"), ty.keyword_name(pick(KINDS)).alias("keyword"), ty.array_type(name, F.col("p_size") % 3).alias("array"),
        ty.union_type(F.array(name, F.lit("number"), name)).alias("either"), ty.default_constant(pick(["number", "string", "boolean", "null", "Shop"])).alias("value"), ty.element_type(F.array(name, F.lit("number"))).alias("element"),
    )


@query
def import_files(s, d):
    """Where imports lead: relative ones, the system's, named SDKs, and dependencies, of which the last declared counts."""
    p = s.read.parquet(f"{d}/part.parquet").select("p_partkey", F.concat(F.lit("src/a/f"), F.col("p_partkey").cast("string"), F.lit(".ts")).alias("path"), F.split("p_name", " ")[0].alias("w"))
    spec = F.element_at(F.array(F.concat(F.lit("./"), F.col("w")), F.concat(F.lit("../../lib/"), F.col("w"), F.lit(".ts")), F.concat(F.lit("@ohos."), F.col("w")), F.lit("kit"), F.concat(F.lit("@shop/core/"), F.col("w")), F.col("w")), (F.col("p_partkey") % 6 + 1).cast("int"))
    packages = s.createDataFrame([("@shop/core", "old/core", 1), ("@shop/core", "libs/core", 2), ("other", "x", 3)], "name string, target string, ord int")
    imports = p.select("path", spec.alias("from_spec"))
    return project.import_files(imports, packages, s.createDataFrame([("kit",)], "name string"))


@query
def governing_packages(s, d):
    """The package files above each source file, on folders made of nations and regions."""
    n = s.read.parquet(f"{d}/nation.parquet")
    r = F.concat(F.lit("r"), F.col("n_regionkey").cast("string"))
    files = n.select(F.concat(r, F.lit("/n"), F.col("n_nationkey").cast("string"), F.lit("/main.ts")).alias("path")).unionByName(n.select(F.concat(r, F.lit("/n"), F.col("n_nationkey").cast("string"), F.lit("/hvigorfile.ts")).alias("path")))
    packages = n.where("n_regionkey % 2 = 0").select(F.concat(r, F.lit("/oh-package.json5")).alias("path")).distinct().unionByName(n.where("n_nationkey % 3 = 0").select(F.concat(r, F.lit("/n"), F.col("n_nationkey").cast("string"), F.lit("/oh-package.json5")).alias("path")))
    packages = packages.unionByName(s.createDataFrame([("oh-package.json5",)], "path string"))
    return project.governing_packages(files, packages).select("path", F.array_join("packages", ",").alias("packages"))


@query
def original_paths(s, d):
    """What generated files were made of: parts of even size have a map."""
    p = s.read.parquet(f"{d}/part.parquet").select(F.concat(F.lit("f"), F.col("p_partkey").cast("string"), F.lit(".ts")).alias("path"), "p_size")
    return project.original_paths(p.select("path").unionByName(p.where("p_size % 2 = 0").select(F.concat("path", F.lit(".map")).alias("path"))))


@query
def changed_files(s, d):
    """Documents whose text is not the one that was known of them: every third was another."""
    docs = s.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("code"), "doc_id")
    known = docs.select("path", F.when(F.col("doc_id") % 3 == 0, F.sha2(F.concat("code", F.lit("x")), 256)).otherwise(F.sha2("code", 256)).alias("hash"))
    return project.changed_files(docs, known.where("path not like '%5'")).select(F.col("path").cast("long").alias("doc_id"))


@query
def overriding_methods(s, d):
    """Methods of one sub-signature in a class and below it: suppliers and nations declare the brands of their lines."""
    m = fact(s, d, "f_method").select("class_id", F.concat("name", F.lit("(number)")).alias("sub_sig"), F.lit(False).alias("is_abstract"))
    nation = fact(s, d, "f_extends").where("sub like 'S%'").select(F.col("sub").alias("class_id"), F.col("sup"))
    up = m.join(nation, "class_id").select(F.col("sup").alias("class_id"), "sub_sig", F.lit(True).alias("is_abstract")).distinct()
    return cg.overriding(m.unionByName(up), cg.descendants(fact(s, d, "f_class"), fact(s, d, "f_extends")))


@query
def source_positions(s, d):
    """Positions of generated text through decoded maps: two mappings a line, at columns 4 and 10."""
    p = s.read.parquet(f"{d}/supplier.parquet").select(F.concat(F.lit("f"), F.col("s_suppkey").cast("string")).alias("path"))
    maps = p.select("path", F.lit("IAAC,MACE;IACC").alias("mappings"))
    asked = F.explode(F.array(*[F.struct(F.lit(a).alias("line"), F.lit(b).alias("col")) for a, b in ((1, 0), (1, 4), (1, 5), (1, 11), (2, 2), (3, 1))])).alias("x")
    return project.original_positions(p.select("path", asked).select("path", "x.*"), maps)


@query
def json5_values(s, d):
    """Names and versions in package texts with comments, loose keys and trailing commas."""
    p = s.read.parquet(f"{d}/part.parquet")
    text = F.concat(F.lit("// "), F.col("p_brand"), F.lit("\n{name: '"), F.col("p_brand"), F.lit("', \"size\": "), F.col("p_size").cast("string"), F.lit(", deps: {'a': "), F.col("p_partkey").cast("string"), F.lit(".50,}, /* x */ on: true,}"))
    return p.select("p_partkey", text.alias("text")).mapInArrow(project.read_packages("text", ["name", "size", "deps.a", "on"]), "p_partkey long, name string, size string, `deps.a` string, on string").withColumnRenamed("deps.a", "dep")


def queries() -> dict:
    from .programs import QUERIES as programs

    return {**QUERIES, **programs}


def oracle_sql() -> dict[str, str]:
    from .oracle import oracle_sql as found

    return found()
