"""Analyses of parsed projects: their facts resolved to the relations that the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import callgraph, cfg, resolve
from ..operators.fixpoint import closure, fixpoint
from ..sources.lowering import DEFAULT_CLASS, DEFAULT_METHOD
from ..sources.printer import dump
from ..sources.project import Program, import_target
from ..tables import durable


def homes(program: Program) -> DataFrame:
    """(path, class_sig, home, is_default): the namespace, or file, that each class stands in, by signature."""
    return program["class"].select("path", F.col("sig").alias("class_sig"), F.coalesce("namespace", "owner").alias("home"), (F.col("name") == DEFAULT_CLASS).alias("is_default"))


def scopes(program: Program) -> DataFrame:
    """(scope, up, depth): every namespace and file with itself and what it stands in, and how deep ``up`` lies."""
    files = homes(program).where("is_default").select(F.col("home").alias("node"))
    spaces = program["namespace"].select("sig", "parent")
    nodes = files.unionByName(spaces.select(F.col("sig").alias("node"))).unionByName(spaces.select(F.col("parent").alias("node"))).distinct()
    up = durable(closure(spaces.select(F.col("sig").alias("src"), F.col("parent").alias("dst")), nodes), "scopes")
    depth = up.groupBy("src").agg(F.count(F.lit(1)).cast("int").alias("depth")).withColumnRenamed("src", "up")
    return up.select(F.col("src").alias("scope"), F.col("dst").alias("up")).join(depth, "up")


def entities(program: Program) -> DataFrame:
    """(path, home, kind, name, entity): classes, namespaces, functions and variables by where they are declared."""
    home = homes(program)
    classes = program["class"].where(F.col("name") != DEFAULT_CLASS).select("path", F.coalesce("namespace", "owner").alias("home"), F.lit("class").alias("kind"), "name", F.col("sig").alias("entity"))
    spaces = program["namespace"].select("path", F.col("parent").alias("home"), F.lit("namespace").alias("kind"), "name", F.col("sig").alias("entity"))
    inside = home.where("is_default").select("class_sig", "home")
    functions = program["method"].where(F.col("name") != DEFAULT_METHOD).join(inside, "class_sig").select("path", "home", F.lit("function").alias("kind"), "name", F.col("sig").alias("entity"))
    main = program["method"].where(F.col("name") == DEFAULT_METHOD).join(inside, "class_sig").select(F.col("sig").alias("method_sig"), "home")
    plain = (F.col("name") != "this") & ~F.startswith("name", F.lit("$"))
    defined = program["stmt"].where("def is not null").select("method_sig", F.col("def").alias("name")).distinct()
    variables = program["local"].where(plain).join(defined, ["method_sig", "name"]).join(main, "method_sig").select("path", "home", F.lit("local").alias("kind"), "name", F.concat("home", F.lit("#"), "name").alias("entity"))
    return classes.unionByName(spaces).unionByName(functions).unionByName(variables)


def exported(program: Program, found: DataFrame) -> DataFrame:
    """The exports of files as the re-export chase takes them, each entity under its kind."""
    stem = lambda c: F.regexp_replace(c, r"(\.d)?\.ts$", "")
    none = F.lit(None).cast("string")
    file_home = homes(program).where("is_default").select("path", "home")
    exports = program["export"]
    own = found.join(file_home, ["path", "home"]).select(stem(F.col("path")).alias("file"), "name", F.concat_ws("\n", "kind", "entity").alias("entity"), none.alias("from_file"), none.alias("from_name"))
    renamed = exports.where("name_before_as is not null and from_spec is null").select(stem(F.col("path")).alias("file"), F.col("clause").alias("name"), none.alias("entity"), stem(F.col("path")).alias("from_file"), F.col("name_before_as").alias("from_name"))
    passed = exports.where("from_spec is not null and clause <> '*'").select(stem(F.col("path")).alias("file"), F.col("clause").alias("name"), none.alias("entity"), import_target(F.col("path"), F.col("from_spec")).alias("from_file"), F.coalesce("name_before_as", "clause").alias("from_name"))
    default = exports.where("is_default").select(stem(F.col("path")).alias("file"), F.lit("default").alias("name"), none.alias("entity"), stem(F.col("path")).alias("from_file"), F.col("clause").alias("from_name"))
    return own.unionByName(renamed).unionByName(passed).unionByName(default)


def visible_entities(program: Program) -> DataFrame:
    """(path, scope, kind, name, entity): what each name means in each namespace and file, dotted names through namespaces included.

    What the scope declares comes first, then what it stands in, nearest first, then imports, through aliases and re-exports.
    """
    if "visible" in program.tables:
        return program.tables["visible"]
    found = durable(entities(program), "entities")
    up = durable(scopes(program), "scopes")
    # a name relative to any scope around its declaration: what is left of its path there
    around = found.join(up.select(F.col("scope").alias("home"), "up", "depth"), "home")
    inside = F.when(F.col("home") == F.col("up"), F.lit("")).otherwise(F.concat(F.expr("substring(home, length(up) + if(up like '%: ', 1, 2))"), F.lit(".")))
    named = around.select("up", "depth", "kind", F.concat(inside, "name").alias("name"), "entity")
    paths = program["class"].where(F.col("name") == DEFAULT_CLASS).select("path", F.coalesce("namespace", "owner").alias("scope"))
    near = up.select("scope", "up").join(named, "up").select("scope", "kind", "name", "entity", (1_000 - F.col("depth")).alias("rank"))
    imports = program["import"].select("path", F.col("clause").alias("clause"), F.when(F.col("kind") == "Identifier", "default").otherwise(F.coalesce("name_before_as", "clause")).alias("wanted"), import_target(F.col("path"), F.col("from_spec")).alias("file")).where("file is not null")
    chased = resolve.reexport_chase(imports.where("wanted <> '*'").select("file", F.col("wanted").alias("name")).distinct(), exported(program, found), groups=[F.substring_index("entity", "\n", 1).alias("kind")])
    got = imports.join(chased.select("file", F.col("name").alias("wanted"), "kind", F.expr("substring(entity, length(kind) + 2)").alias("entity")), ["file", "wanted"]).select("path", F.col("clause").alias("name"), "kind", "entity")
    # members of an imported namespace, and of a file imported as a whole
    members = got.where("kind = 'namespace'").join(named.select(F.col("up").alias("entity"), F.col("kind").alias("k"), F.col("name").alias("member"), F.col("entity").alias("e")), "entity").select("path", F.concat_ws(".", "name", "member").alias("name"), F.col("k").alias("kind"), F.col("e").alias("entity"))
    files = paths.where("scope like '%: '").select(F.regexp_replace("path", r"(\.d)?\.ts$", "").alias("file"), F.col("scope").alias("up"))
    whole = imports.where("wanted = '*'").join(files, "file").join(named, "up").select("path", F.concat_ws(".", "clause", "name").alias("name"), "kind", "entity")
    imported = got.select("path", "name", "kind", "entity").unionByName(members).unionByName(whole)
    both = near.join(paths, "scope").unionByName(imported.join(paths, "path").select("scope", "kind", "name", "entity", F.lit(2_000).alias("rank"), "path"))
    program.tables["visible"] = durable(resolve.ranked_lookup(both, ["path", "scope", "kind", "name"], ["rank", "entity"]).select("path", "scope", "kind", "name", "entity"), "visible")
    return program.tables["visible"]


def visible_from_class(program: Program) -> DataFrame:
    """(class_sig, kind, name, entity): the variables and static fields that code of a class can name, those of classes in sight by dotted names."""
    home = homes(program).where("not is_default").select("path", "class_sig", F.col("home").alias("scope"))
    seen = home.join(visible_entities(program), ["path", "scope"])
    variables = seen.where("kind = 'local'").select("class_sig", F.lit("variable").alias("kind"), "name", "entity")
    static = program["field"].where("is_static").select(F.col("class_sig").alias("entity"), F.col("name").alias("field"), F.col("sig"))
    fields = seen.where("kind = 'class'").join(static, "entity").select("class_sig", F.lit("field").alias("kind"), F.concat_ws(".", "name", "field").alias("name"), F.col("sig").alias("entity"))
    return variables.unionByName(fields)


def class_names(program: Program) -> DataFrame:
    """(path, scope, name, class_sig): what a class name means in each scope."""
    return visible_entities(program).where("kind = 'class'").select("path", "scope", "name", F.col("entity").alias("class_sig"))


def method_scopes(program: Program) -> DataFrame:
    """(path, method_sig, owner, scope, caller): each method with its class, the scope that names in it are looked up in, and its identity in call graphs."""
    home = homes(program).select(F.col("class_sig").alias("owner"), F.col("home").alias("scope"))
    m = program["method"].select("path", F.col("sig").alias("method_sig"), F.col("class_sig").alias("owner"), callgraph.method_id(F.col("class_sig"), F.col("name")).alias("caller"))
    return m.join(home, "owner")


def function_values(program: Program) -> DataFrame:
    """(path, method_sig, name, function): locals that hold a function, through copies: the function's name."""
    s = program["stmt"].where("kind = 'assign' and def is not null")
    held = s.where("op = 'function'").select("path", "method_sig", F.col("def").alias("name"), F.col("member").alias("function"))
    copies = s.where("op = 'name'").select("path", "method_sig", F.col("def").alias("name"), F.get("args", F.lit(0)).alias("from"))
    visible = visible_entities(program).where("kind = 'function'").select("path", "scope", F.col("name").alias("from"), F.col("name").alias("function"))
    named = copies.join(method_scopes(program).select("path", "method_sig", "scope"), ["path", "method_sig"]).join(visible, ["path", "scope", "from"]).select("path", "method_sig", "name", "function")
    step = lambda new, _: copies.join(new.withColumnRenamed("name", "from"), ["path", "method_sig", "from"]).select("path", "method_sig", "name", "function")
    return fixpoint(held.unionByName(named), step)


def call_facts(program: Program) -> dict[str, DataFrame]:
    """The relations of the call-graph operators; methods are told apart by class and name."""
    names = class_names(program)
    classes = program["class"].select(F.col("sig").alias("class_id"), (F.col("origin") == "interface").alias("is_iface"), F.array_contains("modifiers", "abstract").alias("abs"))
    classes = classes.select("class_id", (F.col("is_iface") | F.col("abs")).alias("is_abstract"))
    supers = program["class"].select("path", F.coalesce("namespace", "owner").alias("scope"), F.col("sig").alias("sub"), F.explode(F.concat(F.when(F.col("super_name").isNull(), F.array().cast("array<string>")).otherwise(F.array("super_name")), "interfaces")).alias("name"))
    extends = supers.join(names, ["path", "scope", "name"]).select("sub", F.col("class_sig").alias("sup"))
    methods = program["method"].where("not is_abstract").select(F.col("class_sig").alias("class_id"), "name").distinct()
    owner = method_scopes(program)
    from .inference import infer_types

    sigs = program["class"].select(F.col("sig").alias("type"))
    local = infer_types(program).join(sigs, "type", "left_semi").select("path", "method_sig", F.col("name").alias("base"), F.col("type").alias("recv"))
    calls = durable(program["call"].join(owner, ["path", "method_sig"]), "calls")
    typed = calls.where("kind = 'instance'").join(local, ["path", "method_sig", "base"], "left")
    # a receiver is `this`, a local of a class, a class itself, or a namespace
    as_class = typed.where("base <> 'this' and recv is not null").select("caller", "recv", "callee")
    as_class = as_class.unionByName(typed.where("base <> 'this' and recv is null").withColumn("name", F.col("base")).join(names, ["path", "scope", "name"]).select("caller", F.col("class_sig").alias("recv"), "callee"))
    own = typed.where("base = 'this'").select("caller", F.col("owner").alias("recv"), "callee")
    functions = visible_entities(program).where("kind = 'function'").select("path", "scope", "name", F.col("entity").alias("function"))
    where = program["method"].select(F.col("sig").alias("function"), F.col("class_sig").alias("recv"), F.col("name").alias("callee"))
    values = function_values(program).select("path", "method_sig", "name", F.col("function").alias("held"))
    called = calls.where("kind = 'static'").withColumn("name", F.col("callee")).unionByName(calls.where("kind = 'instance' and base <> 'this'").withColumn("name", F.concat_ws(".", "base", "callee")))
    called = called.drop("callee").join(values, ["path", "method_sig", "name"], "left").withColumn("name", F.coalesce("held", "name"))
    static = called.join(functions, ["path", "scope", "name"]).join(where, "function").select("caller", "recv", "callee")
    # a function that is written where it is used belongs to the class around it
    inner = called.where("held is not null").select("caller", F.col("owner").alias("recv"), F.col("held").alias("callee")).join(methods.select(F.col("class_id").alias("recv"), F.col("name").alias("callee")), ["recv", "callee"], "left_semi").select("caller", "recv", "callee")
    allocs = program["alloc"].join(owner, ["path", "method_sig"]).withColumnRenamed("class_name", "name").join(names, ["path", "scope", "name"]).select("caller", F.col("class_sig").alias("class_id"))
    return {"classes": classes, "extends": extends, "methods": methods, "sites": as_class.unionByName(own).unionByName(static).unionByName(inner).distinct(), "allocs": allocs.distinct()}


def inherited_methods(facts: dict[str, DataFrame]) -> DataFrame:
    """(class_id, name, owner): the method a class answers a name with, its own or the nearest above it."""
    start = facts["methods"].select("class_id", "name", F.col("class_id").alias("owner"))
    scopes = facts["extends"].select(F.col("sub").alias("scope"), F.col("sup").alias("parent"))
    return resolve.shadowed_names(scopes, start.select(F.col("class_id").alias("scope"), "name", F.col("owner").alias("entity"))).select(F.col("scope").alias("class_id"), "name", F.col("entity").alias("owner"))


def call_graph(program: Program, how: str = "cha", entries: DataFrame | None = None) -> DataFrame:
    """(caller, target) by class hierarchy (``cha``) or rapid type analysis (``rta``, from ``entries``); inherited methods are found."""
    f = call_facts(program)
    owned = durable(inherited_methods(f), "inherited")
    edges = callgraph.cha_edges(f["classes"], f["extends"], owned.select("class_id", "name").distinct(), f["sites"])
    edges = edges.withColumn("name", F.expr("substring(target, length(class_id) + 2)")).join(owned, ["class_id", "name"])
    edges = durable(edges.select("caller", callgraph.method_id(F.col("owner"), F.col("name")).alias("target"), "class_id").distinct(), "edges")
    if how == "cha":
        return edges.select("caller", "target").distinct()
    # default classes are there from the start
    there = F.endswith("class_id", F.lit(DEFAULT_CLASS))
    seeds = edges.where(there).select("caller", "class_id").distinct()
    allocs = f["allocs"].unionByName(seeds)
    return callgraph.rta_edges(entries, edges, allocs)


def statement_number():
    """A statement's number in its method: its block in the upper half, its place there in the lower."""
    return F.shiftleft(F.col("block").cast("long"), 32) + F.col("idx")


def flow_graph(program: Program) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Edges, blocks and statements with the columns of the control-flow operators; methods are hashes of their signatures."""
    m = F.xxhash64("path", "method_sig").alias("method")
    edges = program["edge"].select(m, F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))
    blocks = program["block"].select(m, F.col("block").cast("long").alias("block"))
    s = program["stmt"].select(m, F.col("block").cast("long").alias("block"), "idx", "def", "uses", statement_number().alias("stmt"))
    used = s.select("method", "block", (F.col("idx") * 2).alias("idx"), "stmt", F.explode("uses").alias("name"), F.lit(False).alias("is_def"))
    made = s.where("def is not null").select("method", "block", (F.col("idx") * 2 + 1).alias("idx"), "stmt", F.col("def").alias("name"), F.lit(True).alias("is_def"))
    return edges, blocks, used.unionByName(made)


def phi_functions(program: Program) -> DataFrame:
    edges, blocks, stmts = (durable(x, "flow") for x in flow_graph(program))
    defs = stmts.where("is_def").select("method", "name", "block").distinct()
    return cfg.phi_sites(defs, durable(cfg.dominance_frontier(edges, blocks), "frontier"))


def def_use(program: Program) -> DataFrame:
    edges, _, stmts = (durable(x, "flow") for x in flow_graph(program))
    return cfg.global_def_use(stmts, edges)


def dot(program: Program) -> DataFrame:
    """(path, dot): a GraphViz digraph a file, a cluster a method, a node a block with its statements, an edge a successor."""
    prefix = F.concat(F.lit("n"), F.substring(F.sha2("method_sig", 256), 1, 24), F.lit("_"))
    quoted = F.replace("text", F.lit('"'), F.lit('\\"'))
    lines = program["stmt"].groupBy("path", "method_sig", "block").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", quoted.alias("t")))), lambda x: x["t"]), "\\n").alias("label"))
    node = lines.select("path", "method_sig", F.lit(0).alias("part"), F.col("block").alias("a"), F.lit(0).alias("b"), F.concat(F.lit("    "), prefix, "block", F.lit(' [label="'), "label", F.lit('"];')).alias("line"))
    edge = program["edge"].select("path", "method_sig", F.lit(1).alias("part"), F.col("src").alias("a"), F.col("ord").alias("b"), F.concat(F.lit("    "), prefix, "src", F.lit(" -> "), prefix, "dst", F.lit(";")).alias("line"))
    body = node.unionByName(edge).groupBy("path", "method_sig").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "a", "b", "line"))), lambda x: x["line"]), "\n").alias("body"))
    cluster = F.concat(F.lit('  subgraph "cluster_'), "method_sig", F.lit('" {\n    label="'), "method_sig", F.lit('";\n'), "body", F.lit("\n  }"))
    return body.groupBy("path").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("method_sig", cluster.alias("c")))), lambda x: x["c"]), "\n").alias("all")).select("path", F.concat(F.lit("digraph {\n"), "all", F.lit("\n}\n")).alias("dot"))


def dump_dot(program: Program, out: str) -> None:
    """Write the graphs of :func:`dot`, a folder a source file."""
    dump(dot(program).select("path", F.col("dot").alias("text")), out)


def listing(program: Program) -> DataFrame:
    """(path, ord, line_text): classes, fields and methods of each file as source-like text, by line."""
    c = program["class"].where(F.col("name") != DEFAULT_CLASS)
    up = F.when(F.col("super_name").isNotNull(), F.concat(F.lit(" extends "), "super_name")).otherwise(F.lit(""))
    heads = c.select("path", "line", F.lit(0).alias("rank"), F.concat(F.array_join("modifiers", " "), F.when(F.size("modifiers") > 0, " ").otherwise(""), "origin", F.lit(" "), "name", up).alias("line_text"))
    fields = program["field"].select("path", "line", F.lit(1).alias("rank"), F.concat(F.lit("  "), "name", F.lit(": "), "type", F.when(F.col("initializer").isNull(), "").otherwise(F.concat(F.lit(" = "), "initializer"))).alias("line_text"))
    methods = program["method"].where(~F.startswith("name", F.lit("_DEFAULT"))).select("path", "line", F.lit(2).alias("rank"), F.concat(F.lit("  "), "sub_sig", F.lit(": "), "return_type").alias("line_text"))
    w = Window.partitionBy("path").orderBy("line", "rank", "line_text")
    return heads.unionByName(fields).unionByName(methods).select("path", F.row_number().over(w).alias("ord"), "line_text")
