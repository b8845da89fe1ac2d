"""Import graphs: which tests reach a change, and how specifiers resolve."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions import ordering, paths
from gristmill.functions import patterns as P
from gristmill.operators.tamper import is_test_file, language_of


#: Rules of the settings that one query takes.
MOST_RULES = 200


def reaching(edges: DataFrame, changed: DataFrame, most_rounds: int = 100) -> DataFrame:
    """node, depth of all that reaches a changed node (node) along edges (src imports dst); cycles are fine.

    Each round joins only the newest layer with the edges; layers are cut from their lineage by checkpoints.
    """
    ordering.ensure_checkpoints(edges.sparkSession)
    seen = layer = changed.select("node").distinct().withColumn("depth", F.lit(0)).checkpoint()
    for depth in range(1, most_rounds + 1):
        new = edges.join(layer.select(F.col("node").alias("dst")), "dst", "left_semi").select(F.col("src").alias("node")).distinct()
        layer = new.join(seen, "node", "left_anti").withColumn("depth", F.lit(depth)).checkpoint()
        if layer.isEmpty():
            return seen
        seen = seen.unionByName(layer)
    raise RuntimeError(f"the graph is deeper than {most_rounds}")


def select_tests(candidates: DataFrame, most: int) -> DataFrame:
    """file, priority of the first ``most`` tests: named (1), then direct (2), then further ones (3); each once."""
    best = candidates.groupBy("file").agg(F.min("priority").alias("priority"))
    return best.orderBy("priority", "file").limit(most)


def omitted_tests(candidates: DataFrame, most: int) -> DataFrame:
    """One row, omitted: how many tests the limit leaves out."""
    return candidates.agg(F.greatest(F.count_distinct("file") - most, F.lit(0)).alias("omitted"))


def sibling_tests(file: Column) -> Column:
    """Names that a source's test can have by its language's convention."""
    language = language_of(file)
    stem, ext = F.regexp_replace(file, r"\.[^./]*\z", ""), F.regexp_extract(file, r"(\.[^./]*)\z", 1)
    folder, base = F.regexp_extract(stem, r"^(.*/)?[^/]*\z", 1), paths.name(stem)
    names = {
        "ts": [F.concat(stem, F.lit(".test"), ext), F.concat(stem, F.lit(".spec"), ext)],
        "py": [F.concat(folder, F.lit("test_"), base, F.lit(".py")), F.concat(F.lit("tests/test_"), base, F.lit(".py"))],
        "rust": [F.concat(stem, F.lit("_test.rs")), F.concat(folder, F.lit("tests/"), base, F.lit(".rs")), F.concat(F.lit("tests/"), base, F.lit(".rs"))],
        "ruby": [F.concat(stem, F.lit("_test.rb")), F.concat(stem, F.lit("_spec.rb"))],
    }
    unit = F.array(F.concat(stem, F.lit("Test"), ext), F.concat(stem, F.lit("Tests"), ext))
    out = F.when(language.isin("java", "kotlin", "csharp", "swift", "php"), unit).when(language.isin("go", "cpp", "dart"), F.array(F.concat(stem, F.lit("_test"), ext)))
    for name, found in names.items():
        out = out.when(language == name, F.array(*found))
    return out.otherwise(F.array().cast("array<string>"))


def stem_tests(sources: DataFrame, files: DataFrame) -> DataFrame:
    """source, file: test files in a source's folder whose name goes on after its stem and a point."""
    own = sources.select(F.col("file").alias("source"), F.regexp_replace("file", r"\.[^./]*\z", "").alias("stem"))
    # Every beginning of a test's name that ends before a point is looked up.
    parts = F.split(paths.name(F.col("file")), r"\.")
    heads = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.concat(F.regexp_extract("file", r"^(.*/)?[^/]*\z", 1), F.array_join(F.slice(parts, F.lit(1), i), ".")))
    tests = files.where(is_test_file(F.col("file")) & (F.size(parts) > 1)).select("file", F.explode(heads).alias("stem"))
    return own.join(tests, "stem").select("source", "file").distinct()


def named_tests(sources: DataFrame, files: DataFrame) -> DataFrame:
    """source, file: tests that exist under a conventional name."""
    names = sources.select(F.col("file").alias("source"), F.explode(sibling_tests(F.col("file"))).alias("file"))
    return names.join(files.select("file").distinct(), "file", "left_semi").select("source", "file")


def import_specifiers(lines: DataFrame) -> DataFrame:
    """file, specifier of import, export-from, require and dynamic import (file, text)."""
    return lines.select("file", F.explode(F.regexp_extract_all("text", F.lit(P.MODULE), F.lit(1))).alias("specifier")).distinct()


def import_bindings(lines: DataFrame) -> DataFrame:
    """file, name, local, specifier of named imports, static and awaited, with aliases (file, text of whole files)."""

    def bound(pattern: str, alias: str) -> DataFrame:
        names, froms = (F.regexp_extract_all("text", F.lit(pattern), F.lit(i)) for i in (1, 2))
        rows = lines.select("file", F.explode(F.arrays_zip(names.alias("names"), froms.alias("specifier"))).alias("x"))
        one = rows.select("file", F.explode(F.transform(F.split("x.names", ","), lambda n: F.regexp_replace(F.regexp_replace(n, r"^\s+|\s+\z", ""), r"^type\s+", ""))).alias("b"), "x.specifier").where("b <> ''")
        part = F.split("b", alias)
        return one.select("file", F.get(part, F.lit(0)).alias("name"), F.element_at(part, -1).alias("local"), "specifier")

    return bound(P.NAMED_IMPORT, r"\s+as\s+").unionByName(bound(P.AWAITED_IMPORT, r"\s*:\s*"))


def binding_sources(bindings: DataFrame, sources: DataFrame) -> DataFrame:
    """file, local, source: imported names of relative modules that are project sources (file); of several the first candidate."""
    base = paths.joined(paths.folder(F.col("file")), F.col("specifier"))
    tails = ["", ".ts", ".tsx", ".js", ".jsx", ".mts", ".cts", "/index.ts", "/index.tsx", "/index.js"]
    tried = bindings.where(F.col("specifier").startswith(".")).select("file", "local", "specifier", F.posexplode(F.array(*(F.concat(base, F.lit(t)) for t in tails))).alias("i", "source"))
    hit = tried.join(sources.select(F.col("file").alias("source")).distinct(), "source", "left_semi")
    return hit.groupBy("file", "local", "specifier").agg(F.min_by("source", "i").alias("source")).select("file", "local", "source")


def exported_functions(files: DataFrame) -> DataFrame:
    """file, name of exported functions and arrow constants (file, text), each once."""
    found = F.concat(*(F.regexp_extract_all("text", F.lit(p), F.lit(1)) for p in P.EXPORTED_FUNCTIONS))
    return files.select("file", F.explode(F.array_distinct(found)).alias("name"))


# Aliases


def declared_aliases(configs: DataFrame) -> DataFrame:
    """file, declares, parent, aliases of tsconfig texts (file, text): whether it declares paths, the config that it extends, and STRUCT<key, path, i>.

    The texts hold comments and trailing commas, so they are read by patterns; paths count from baseUrl.
    """
    text, folder = F.col("text"), paths.folder(F.col("file"))
    body = F.regexp_extract(text, P.TSCONFIG_PATHS, 1)
    base = F.coalesce(F.nullif(F.regexp_extract(text, P.TSCONFIG_BASE, 1), F.lit("")), F.lit("."))
    keys, lists = (F.regexp_extract_all(body, F.lit(P.TSCONFIG_ENTRY), F.lit(i)) for i in (1, 2))
    targets = lambda x: F.regexp_extract_all(x, F.lit(P.TSCONFIG_TARGET), F.lit(1))
    pairs = F.flatten(F.zip_with(keys, lists, lambda k, v: F.transform(targets(v), lambda t: F.struct(k.alias("key"), paths.joined(paths.joined(folder, base), t).alias("path")))))
    parent = F.regexp_extract(text, P.TSCONFIG_EXTENDS, 1)
    parent = F.when(parent != "", paths.joined(folder, F.when(parent.endswith(".json"), parent).otherwise(F.concat(parent, F.lit(".json")))))
    return configs.select("file", text.rlike(P.TSCONFIG_PATHS).alias("declares"), parent.alias("parent"), F.transform(pairs, lambda p, i: F.struct(p["key"].alias("key"), p["path"].alias("path"), i.alias("i"))).alias("aliases"))


def chain_ends(links: DataFrame) -> DataFrame:
    """node, end: where each node's chain of ``links`` (node, next) ends; nodes whose chain comes back to itself have none.

    Pointer doubling: each round sends every open pointer to where its target points, so a chain of n steps
    takes the logarithm of n rounds. The steps that chains have to their ends leave out no number, so each round closes
    some pointer until those are left that go round in a circle or into one: a round that closes none is the last. A
    link to a node that is not there ends before it. Each round is one join, cut from its lineage; a node has one
    link, or several rows say the same.
    """
    nodes = links.select("node").distinct()
    there = links.join(nodes.select(F.col("node").alias("next")), "next", "left_semi").select("node", "next").distinct()
    now = ordering.saved(nodes.join(there, "node", "left").select("node", F.coalesce("next", "node").alias("end"), F.col("next").isNull().alias("done")))
    before, left = None, now.where("not done").count()
    while left and left != before:
        to = now.select(F.col("node").alias("end"), F.col("end").alias("onward"), F.col("done").alias("ends"))
        moved = now.where("not done").join(to.hint("merge"), "end").select("node", F.col("onward").alias("end"), F.col("ends").alias("done"))
        now = ordering.saved(now.where("done").unionByName(moved))
        before, left = left, now.where("not done").count()
    return now.where("done").select("node", "end")


def inherited_aliases(configs: DataFrame) -> DataFrame:
    """file, aliases of every tsconfig: its own paths, else those of the nearest config along ``extends`` that declares some.

    A chain may have any length. One that comes back to a config, leaves the repository, or ends without paths
    gives no row. A file that occurs twice counts once.
    """
    table = ordering.saved(declared_aliases(configs).dropDuplicates(["file"]))
    up = F.when(~F.col("declares") & ~F.col("parent").startswith(".."), F.col("parent"))
    ends = chain_ends(table.select(F.col("file").alias("node"), up.alias("next")))
    own = table.where("declares").select(F.col("file").alias("end"), "aliases")
    return ends.join(own, "end").select(F.col("node").alias("file"), "aliases")


def package_imports(manifests: DataFrame) -> DataFrame:
    """file, aliases of package.json texts (file, text): ``imports`` keys to a path, or to that of the import or default condition."""
    raw = F.from_json(F.get_json_object("text", "$.imports"), "map<string,string>")
    target = lambda v: F.when(v.startswith("{"), F.coalesce(F.get_json_object(v, "$.import"), F.get_json_object(v, "$.default"))).otherwise(v)
    rows = F.transform(F.map_entries(raw), lambda e: F.struct(e["key"].alias("key"), target(e["value"]).alias("path")))
    kept = F.filter(rows, lambda r: r["path"].isNotNull())
    folder = paths.folder(F.col("file"))
    return manifests.select("file", F.coalesce(F.transform(kept, lambda r, i: F.struct(r["key"].alias("key"), paths.joined(folder, r["path"]).alias("path"), i.alias("i"))), F.array().cast("array<struct<key:string,path:string,i:int>>")).alias("aliases"))


def workspace_packages(manifests: DataFrame) -> DataFrame:
    """name, dir, entry of named packages (file, text) outside node_modules: what a bare import of them reads."""
    text = F.col("text")
    dot = F.coalesce(F.get_json_object(text, "$.exports['.'].import"), F.get_json_object(text, "$.exports['.'].default"), F.get_json_object(text, "$.exports['.']"), F.get_json_object(text, "$.exports"))
    entry = F.coalesce(F.when(~dot.startswith("{"), dot), F.get_json_object(text, "$.module"), F.get_json_object(text, "$.main"), F.lit("src/index"))
    rows = manifests.where((paths.name(F.col("file")) == "package.json") & ~F.col("file").rlike("(^|/)node_modules/"))
    return rows.select(F.get_json_object(text, "$.name").alias("name"), paths.folder(F.col("file")).alias("dir"), entry.alias("entry")).where("name <> ''")


def nearest_aliases(specifiers: DataFrame, tables: DataFrame, config: str) -> DataFrame:
    """Specifiers (file, specifier) with aliases: those of the nearest ``config`` (file, aliases) at or above the file's folder."""
    held = tables.where(paths.name(F.col("file")) == config).select(F.coalesce(F.nullif(paths.folder(F.col("file")), F.lit("")), F.lit(".")).alias("_dir"), F.col("aliases"))
    ups = specifiers.select("file", "specifier", F.posexplode(paths.ancestors(F.col("file"))).alias("_up", "_dir"))
    return ups.join(held, "_dir").groupBy("file", "specifier").agg(F.min_by("aliases", "_up").alias("aliases"))


def expanded(rows: DataFrame) -> DataFrame:
    """file, specifier, base, i: the targets of the key that decides a specifier (file, specifier, aliases).

    An equal key decides, else the one with the longest text before ``*`` that fits; its targets keep their order.
    """
    a = rows.select("file", "specifier", F.explode("aliases").alias("a")).select("file", "specifier", "a.*")
    star = F.instr("key", "*")
    pre, post = F.substr("key", F.lit(1), F.greatest(star - 1, F.lit(0))), F.substr("key", star + 1)
    s = F.col("specifier")
    fits = F.when(star == 0, s == F.col("key")).otherwise(F.startswith(s, pre) & F.endswith(s, post))
    rest = F.substr(s, F.length(pre) + 1, F.greatest(F.length(s) - F.length(pre) - F.length(post), F.lit(0)))
    weight = F.when(s == F.col("key"), 1_000_000).otherwise(F.length(pre))
    hit = a.where(fits).select("file", "specifier", "key", "i", weight.alias("w"), F.when((star == 0) | ~F.contains("path", F.lit("*")), F.col("path")).otherwise(F.concat(F.substring_index("path", "*", 1), rest, F.when(F.contains("path", F.lit("*")), F.substr("path", F.instr("path", "*") + 1)).otherwise(F.lit("")))).alias("base"))
    best = F.max_by("key", F.struct("w", -F.col("i"))).over(Window.partitionBy("file", "specifier"))
    return hit.withColumn("best", best).where("key = best").select("file", "specifier", "base", "i")


def module_targets(specifiers: DataFrame, files: DataFrame, configs: DataFrame, manifests: DataFrame) -> DataFrame:
    """file, specifier, target: the repository's files that module specifiers name, all files of the first target that has any.

    Relative paths; ``#`` names by the imports of the nearest package.json; paths of the nearest tsconfig.json,
    inherited ones too; then workspace packages, the longest name first. A target is a file without its ending
    or a folder's index.
    """
    own = specifiers.select("file", "specifier").distinct()
    spec = F.col("specifier")
    relative = own.where(spec.startswith(".")).select("file", "specifier", F.lit(0).alias("rank"), F.lit(0).alias("i"), paths.joined(paths.folder(F.col("file")), spec).alias("base"))
    hashed = expanded(nearest_aliases(own.where(spec.startswith("#")), package_imports(manifests), "package.json")).withColumn("rank", F.lit(1))
    named = own.where(~spec.startswith(".") & ~spec.startswith("#"))
    aliased = expanded(nearest_aliases(named, inherited_aliases(configs), "tsconfig.json")).withColumn("rank", F.lit(2))
    # The package of a specifier is one of its beginnings that end before a slash.
    part = F.split(spec, "/")
    heads = named.select("file", "specifier", F.explode(F.transform(F.sequence(F.lit(1), F.size(part)), lambda i: F.array_join(F.slice(part, F.lit(1), i), "/"))).alias("name"))
    packages = workspace_packages(manifests)
    best = heads.join(packages, "name").groupBy("file", "specifier").agg(F.max_by(F.struct("name", "dir", "entry"), F.length("name")).alias("p"))
    sub = F.substr("specifier", F.length("p.name") + 2)
    bases = F.when(spec == F.col("p.name"), F.array(paths.joined(F.col("p.dir"), F.col("p.entry")))).otherwise(F.array(paths.joined(F.col("p.dir"), sub), paths.joined(F.col("p.dir"), F.concat(F.lit("src/"), sub))))
    packaged = best.select("file", "specifier", F.posexplode(bases).alias("i", "base")).withColumn("rank", F.lit(3))
    columns = ["file", "specifier", "rank", "i", "base"]
    tried = relative.select(*columns).unionByName(hashed.select(*columns)).unionByName(aliased.select(*columns)).unionByName(packaged.select(*columns))
    stem = paths.without_script_ending(F.col("target"))
    known = files.select(F.col("file").alias("target")).distinct().withColumn("base", F.explode(F.array_distinct(F.array(stem, F.regexp_replace(stem, r"/index\z", "")))))
    hit = tried.withColumn("base", paths.without_script_ending(F.col("base"))).join(known, "base")
    at = F.struct("rank", "i")
    first = F.min(at).over(Window.partitionBy("file", "specifier"))
    return hit.withColumn("_first", first == at).where("_first").select("file", "specifier", "target").distinct()


def direct_tests(targets: DataFrame, sources: DataFrame) -> DataFrame:
    """file: tests that import a changed source (file) themselves, of module targets (file, target)."""
    return targets.where(is_test_file(F.col("file"))).join(sources.select(F.col("file").alias("target")), "target", "left_semi").select("file").distinct()


def path_literals(lines: DataFrame, files: DataFrame) -> DataFrame:
    """file, target: quoted strings of tests that name a tracked file from the test's folder."""
    quoted = F.regexp_extract_all("text", F.lit(P.QUOTED_PATH), F.lit(0))
    rows = lines.select("file", F.explode(F.transform(quoted, lambda q: F.substr(q, F.lit(2), F.length(q) - 2))).alias("s")).select("file", paths.joined(paths.folder(F.col("file")), F.col("s")).alias("target"))
    return rows.join(files.select(F.col("file").alias("target")).distinct(), "target", "left_semi").distinct().select("file", "target")


def layer_violations(edges: DataFrame, rules: DataFrame) -> DataFrame:
    """src, dst, rule of edges that a rule (rule, source, target: patterns) forbids.

    The rules are settings: they become one array, of ``MOST_RULES`` at most, that every edge is held against.
    """
    held = rules.select("rule", "source", "target").limit(MOST_RULES + 1).collect()
    if len(held) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} layer rules")
    hits = F.array_compact(F.array(*(F.when(F.col("src").rlike(r["source"]) & F.col("dst").rlike(r["target"]), F.lit(r["rule"])) for r in held)).cast("array<string>"))
    return edges.select("src", "dst", F.explode(hits).alias("rule"))


def deepest_root(files: DataFrame, roots: DataFrame) -> DataFrame:
    """file, root: the deepest root (root, extensions) that holds a file of its language; ``.`` holds all.

    Every folder of a path is looked up, so there is no comparison of all files with all roots.
    """
    ext = F.regexp_extract("file", r"(\.[A-Za-z]+)\z", 1)
    parts = F.split("file", "/")
    ups = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.when(i == 0, F.lit(".")).otherwise(F.array_join(F.slice(parts, F.lit(1), i), "/")))
    rows = files.select("file", ext.alias("ext"), F.posexplode(ups).alias("depth", "root")).join(roots, "root").where(F.array_contains("extensions", F.col("ext")))
    return rows.groupBy("file").agg(F.max_by("root", "depth").alias("root"))


def language_roots(files: DataFrame, picked: list[str] | None = None) -> DataFrame:
    """language, root, ord: where the languages of a repository (file) live, ``.`` first, then by name and language.

    A folder with a manifest is a root. A Makefile makes one for C and C++ only with such a source below it, and a
    Gradle file of Kotlin's folder one for Java only with a Java source. A language with a source outside its
    roots has the top as well. ``picked`` names the languages that count; without any root they have the top.
    """
    ids = [name for name, _, _, _ in P.LANGUAGES if not picked or name in picked]
    spark = files.sparkSession
    held = [(n, P.glob_regex(m)) for n, _, ms, _ in P.LANGUAGES if n in ids for m in ms.split()]
    given = ordering.saved(files.where(~F.col("file").rlike("(^|/)(" + "|".join(d.replace(".", r"\.") for d in P.IGNORED_DIRS) + ")/")).select("file"))
    at = F.coalesce(F.nullif(paths.folder(F.col("file")), F.lit("")), F.lit("."))
    hits = F.array_compact(F.array(*(F.when(paths.name(F.col("file")).rlike(m), F.lit(n)) for n, m in held)).cast("array<string>"))
    # Patterns cost more than bytes tell, so files are dealt by their number, and matched once for all that follows.
    kept = ordering.dealt(given, 8 * given.count(), "file").distinct()
    kept = ordering.saved(kept.select("file", at.alias("at"), hits.alias("hits"), language_of(F.col("file")).alias("language")))
    rows = kept.select(F.explode("hits").alias("language"), F.col("at").alias("root"), paths.name(F.col("file")).alias("manifest"))
    roots = rows.groupBy("language", "root").agg(F.min("manifest").alias("manifest"))
    sources = kept.select("file", "language").where(F.col("language").isin(*ids))
    below = sources.select("language", F.explode(paths.ancestors(F.col("file"))).alias("root")).distinct()
    kotlin = roots.where("language = 'kotlin'").select("root", F.lit(True).alias("_kotlin"))
    unsure = ((F.col("language") == "cpp") & (F.col("manifest") == "Makefile")) | ((F.col("language") == "java") & F.coalesce("_kotlin", F.lit(False)))
    marked = roots.join(kotlin, "root", "left").withColumn("_unsure", unsure).select("language", "root", "_unsure")
    sure = marked.where("not _unsure").unionByName(marked.where("_unsure").join(below, ["language", "root"], "left_semi")).select("language", "root")
    ups = sources.select("language", "file", F.explode(paths.ancestors(F.col("file"))).alias("root"))
    covered = ups.join(sure, ["language", "root"], "left_semi").select("language", "file").distinct()
    inferred = sources.join(covered, ["language", "file"], "left_anti").select("language", F.lit(".").alias("root")).distinct()
    found = sure.unionByName(inferred).distinct()
    if picked and found.isEmpty():
        found = spark.createDataFrame([(i, ".") for i in ids], "language string, root string")
    order = F.create_map(*(F.lit(x) for i, (n, _, _, _) in enumerate(P.LANGUAGES) for x in (n, i)))
    placed = ordering.sums_before(found.withColumns({"_top": F.col("root") != ".", "_l": F.try_element_at(order, F.col("language"))}), ["_top", "root", "_l"])
    return placed.select("language", "root", (F.col("before") + 1).alias("ord"))


def numbered_by_priority(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Rows with n, their place within the key."""
    return rows.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
