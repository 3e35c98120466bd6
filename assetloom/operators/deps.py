"""Package needs, calls between assets, bundles and environments."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetloom.functions import json
from assetloom.functions.text import strip
from assetloom.operators.ranking import ranked, running_total
from assetloom.session import Rounds, cut_lineage

# Import roots that need no package.
STDLIB_ROOTS = [
    "os", "sys", "re", "json", "ast", "datetime", "math", "collections", "typing", "logging", "tempfile",
    "subprocess", "base64", "hashlib", "abc", "functools", "inspect", "io", "pathlib", "random", "time",
    "threading", "queue", "socket", "struct", "traceback", "uuid", "xml",
]

# Import roots whose package has another name.
PACKAGE_OF_ROOT = {
    "cv2": "opencv-python",
    "PIL": "Pillow",
    "yaml": "PyYAML",
    "fastembed": "fastembed",
    "llama_cpp": "llama-cpp-python",
    "sklearn": "scikit-learn",
    "bs4": "beautifulsoup4",
    "skimage": "scikit-image",
}

# Prepared environments, tried in this order.
BASE_ENVIRONMENTS = {
    "data-science": ["numpy", "pandas", "scipy", "scikit-learn", "matplotlib"],
    "web-scraping": ["requests", "beautifulsoup4", "httpx", "lxml"],
}

_NO_STRINGS = "array<string>"

# Calls of a bundle that one task walks.
MOST_CALLS = 1 << 17


def required_packages(facts: DataFrame) -> DataFrame:
    """Sorted distinct packages per asset; an asset that does not parse needs none."""
    imports = F.filter(F.col("facts"), lambda f: f["kind"].isin("import", "import_from"))
    roots = F.array_except(F.transform(imports, lambda f: f["root"]), F.array(*map(F.lit, STDLIB_ROOTS)))
    names = F.create_map(*[F.lit(x) for pair in PACKAGE_OF_ROOT.items() for x in pair])
    packages = F.transform(roots, lambda r: F.coalesce(F.try_element_at(names, r), r))
    return facts.select("name", F.array_sort(F.array_distinct(packages)).alias("packages"))


def internal_edges(facts: DataFrame, functions: DataFrame) -> DataFrame:
    """Direct-name calls to known assets: distinct ``src``, ``dst`` with the sorted position."""
    calls = F.filter(F.col("facts"), lambda f: f["kind"] == "call")
    names = F.array_distinct(F.transform(calls, lambda f: f["value"]))
    known = functions.select(F.col("name").alias("dst"))
    return facts.select(F.col("name").alias("src"), F.explode(names).alias("dst")).join(known, "dst", "left_semi").select(
        "src", "dst"
    )


def internal_dependencies(edges: DataFrame, functions: DataFrame) -> DataFrame:
    """Per asset the sorted list of called assets; a list is bounded by one source text."""
    lists = edges.groupBy(F.col("src").alias("name")).agg(F.array_sort(F.collect_set("dst")).alias("calls"))
    return functions.select("name").join(lists, "name", "left").select(
        "name", F.coalesce("calls", F.array().cast(_NO_STRINGS)).alias("calls")
    )


def declared_edges(functions: DataFrame) -> DataFrame:
    """Edges listed in the metadata, with their position in the list."""
    listed = json.metadata_list(F.col("metadata"), "internal_dependencies")
    return functions.select(F.col("name").alias("src"), F.posexplode(listed).alias("ord", "dst"))


def ordered_edges(edges: DataFrame) -> DataFrame:
    """Give ``internal_edges`` the position each callee has in its sorted list."""
    lists = edges.groupBy("src").agg(F.array_sort(F.collect_set("dst")).alias("calls"))
    return lists.select("src", F.posexplode("calls").alias("ord", "dst"))


def _known(df: DataFrame, column: str, functions: DataFrame) -> DataFrame:
    return df.join(functions.select(F.col("name").alias(column)), column, "left_semi")


def bundle_closure(edges: DataFrame, roots: DataFrame, functions: DataFrame) -> DataFrame:
    """``(root, node, depth)`` for everything reachable from each known root, with the least number of calls to it.

    Round ``k`` holds the strides, pairs a walk of just ``2**k`` calls apart, and
    all that is less than ``2**k`` calls from its root. Put before a stride, the
    first give all that is less than ``2**(k + 1)`` away, and a stride before a
    stride the next ones. A least way passes every depth below its own, so
    rounds end where nothing lies at the last depth covered: their number grows
    with the logarithm of the longest least way, cycles included. Each round is
    a written table, one join of it with its own strides.
    """
    known = _known(edges.filter("src != dst").select("src", "dst").distinct(), "dst", functions)
    start = _known(roots.select(F.col("name").alias("root")).distinct(), "root", functions)
    rounds = Rounds(roots.sparkSession, "closure")
    first = start.select(F.lit(True).alias("from_root"), "root", F.col("root").alias("node"), F.lit(0).alias("depth"))
    strides = known.select(F.lit(False).alias("from_root"), F.col("src").alias("root"), F.col("dst").alias("node"), F.lit(1).alias("depth"))
    last, rim = rounds.add(first.unionByName(strides), "from_root")
    stride = 1
    while rim:
        found, strides = rounds.all().filter("from_root"), last.filter("NOT from_root")
        ahead = strides.select(F.col("root").alias("node"), F.col("node").alias("_to"))
        longer = found.unionByName(strides).join(ahead, "node").groupBy("from_root", "root", F.col("_to").alias("node"))
        longer = longer.agg((F.min("depth") + stride).alias("depth"))
        stride *= 2
        new = longer.join(found.select("from_root", "root", "node"), ["from_root", "root", "node"], "left_anti")
        last, rim = rounds.add(new, f"from_root AND depth = {stride - 1}")
    return rounds.all().filter("from_root").drop("from_root")


def _post_order(bundle: pa.Table) -> pa.Table:
    """One bundle's calls, walked depth first from its root; an asset comes after all it led to first."""
    name = {n: i for i, n in enumerate(dict.fromkeys(bundle.column("src").to_pylist() + bundle.column("dst").to_pylist()))}
    names, calls = list(name), [[] for _ in name]
    for src, _, dst in sorted(zip(*(bundle.column(c).to_pylist() for c in ("src", "ord", "dst")))):
        if dst is not None:
            calls[name[src]].append(name[dst])
    root = bundle.column("root")[0].as_py()
    seen, order, way = {name[root]}, [], [(name[root], iter(calls[name[root]]))]
    while way:
        node, ahead = way[-1]
        new = next((m for m in ahead if m not in seen), None)
        if new is None:
            order.append(names[node])
            way.pop()
        else:
            seen.add(new)
            way.append((new, iter(calls[new])))
    columns = [pa.array([root] * len(order)), pa.array(order), pa.array(range(1, len(order) + 1), pa.int64())]
    return pa.Table.from_arrays(columns, ["root", "node", "position"])


def bundle_order(
    edges: DataFrame, roots: DataFrame, functions: DataFrame, most_calls: int = MOST_CALLS, closure: DataFrame | None = None
) -> DataFrame:
    """``(root, node, position)``: each bundle's depth-first post-order, from 1.

    The closure tells which calls belong to which bundle. A bundle of up to
    ``most_calls`` calls is walked in the task they meet in, names and positions
    only, so state is constant per asset. Larger ones are ordered in rounds
    without gathering them, see ``_order_by_labels``.
    """
    edges = _known(edges.select("src", "dst", "ord"), "dst", functions)
    edges = cut_lineage(edges.groupBy("src", "dst").agg(F.min("ord").alias("ord")), "edges")
    pairs = bundle_closure(edges, roots, functions) if closure is None else closure
    calls = edges.select(F.col("src").alias("node"), "ord", "dst")
    out = calls.groupBy("node").agg(F.count(F.lit(1)).alias("calls"))
    sizes = pairs.join(out, "node", "left").groupBy("root").agg(F.sum(F.coalesce("calls", F.lit(0))).alias("calls"))
    large = cut_lineage(sizes.filter(F.col("calls") > most_calls).select("root"), "large-bundles")
    own = pairs.select("root", "node").join(large, "root", "left_anti").join(calls, "node", "left")
    small = own.select("root", F.col("node").alias("src"), "ord", "dst").groupBy("root")
    walked = cut_lineage(small.applyInArrow(_post_order, "root string, node string, position long"), "bundle-order")
    return walked if large.isEmpty() else walked.unionByName(_order_by_labels(edges, large))


def _not_better(step: DataFrame, earlier: DataFrame) -> DataFrame:
    """``(root, node)`` of written candidates that an earlier label makes useless.

    Earlier rounds are met on their own columns only. Where the candidates are
    few, as in most rounds, they are copied to the scan and nothing else moves.
    """
    held = earlier.select(*[F.col(c).alias(f"_{c}") for c in earlier.columns])
    same = (F.col("root") == F.col("_root")) & (F.col("node") == F.col("_node"))
    return held.join(step, same & (F.col("_label") <= F.col("label"))).select("root", "node").distinct()


def _order_by_labels(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """The post-order of bundles too large for one task, from written ``edges`` between known assets.

    An asset's label is the list of child positions on the path a depth-first
    walk takes to it. That path is the least one, compared element by element,
    so labels come from rounds of "extend by a child, keep the least": a walk
    that returns to an asset on its own path only lengthens that asset's label
    and is dropped. Children sort before parents by closing every label with a
    value no child position reaches. Labels are as long as their paths.
    """
    rounds = Rounds(roots.sparkSession, "labels")
    step, found = rounds.add(roots.select("root", F.col("root").alias("node"), F.array().cast("array<int>").alias("label")))
    while found:
        earlier = rounds.before(rounds.number - 1) if rounds.number > 1 else None
        new = step if earlier is None else step.join(_not_better(step, earlier), ["root", "node"], "left_anti")
        longer = new.join(edges, F.col("node") == F.col("src")).select(
            "root", F.col("dst").alias("node"), F.array_append("label", F.col("ord")).alias("label")
        )
        step, found = rounds.add(longer.groupBy("root", "node").agg(F.min("label").alias("label")))
    least = rounds.all().groupBy("root", "node").agg(F.min("label").alias("label"))
    closed = least.withColumn("label", F.array_append("label", F.lit(2**31 - 1)))
    ranks = ranked(closed, ["root"], ["label"], "bundles")
    return ranks.select("root", "node", F.col("rank").cast("long").alias("position"))


def _sections(functions: DataFrame) -> DataFrame:
    section = F.concat(F.lit("# --- "), F.col("name"), F.lit(" ---\n"), F.coalesce("code", F.lit("None")))
    return functions.select(F.col("name").alias("node"), section.alias("section"))


def bundle_rows(order: DataFrame, functions: DataFrame) -> DataFrame:
    """One row per asset of a bundle, with its printed section."""
    return order.join(_sections(functions), "node").select("root", "position", "node", "section")


def bundle_code(order: DataFrame, functions: DataFrame, roots: DataFrame, part_bytes: int | None = None) -> DataFrame:
    """Bundle text per root: sections joined by a blank line, ``Not found.`` if none.

    For readers that want text; ``bundle_rows`` is the form for any size. A
    bundle's text is one row, or with ``part_bytes`` rows of about that size,
    which joined in order by a blank line give the whole. Parts are cut from the
    sections' lengths; texts move once, to their part.
    """
    if part_bytes is None:
        placed = order.withColumn("part_no", F.lit(0).cast("long"))
    else:
        sizes = _sections(functions).select("node", (F.octet_length("section") + 2).alias("size"))
        sized = running_total(order.join(sizes, "node"), ["root"], ["position"], "size", "sections")
        placed = sized.withColumn("part_no", F.floor(F.col("before") / part_bytes).cast("long"))
    rows = placed.select("root", "position", "node", "part_no").join(_sections(functions), "node")
    sections = F.transform(F.array_sort(F.collect_list(F.struct("position", "section"))), lambda s: s["section"])
    texts = rows.groupBy("root", "part_no").agg(F.array_join(sections, "\n\n").alias("code"))
    asked = roots.select(F.col("name").alias("root")).distinct()
    return asked.join(texts, "root", "left").select(
        "root", F.coalesce("part_no", F.lit(0)).alias("part_no"), F.coalesce("code", F.lit("Not found.")).alias("code")
    )


def _lowered(items: Column) -> Column:
    return F.transform(items, lambda d: F.lower(strip(d)))


def _bare_name(requirement: Column) -> Column:
    before = F.substring_index(F.substring_index(requirement, "==", 1), ">=", 1)
    return F.lower(strip(before))


def _hash(items: Column, length: int) -> Column:
    joined = F.array_join(F.array_sort(items), "|")
    return F.substring(F.sha2(joined.cast("binary"), 256), 1, length)


def env_fingerprint(deps: Column) -> Column:
    """Name of the environment a dependency list needs."""
    wanted = F.transform(deps, _bare_name)
    chosen = F.when(F.size(deps) == 0, F.lit("default"))
    for base, packages in BASE_ENVIRONMENTS.items():
        offered = F.array(*map(F.lit, packages))
        name = F.concat(F.lit(f"base_{base}_"), _hash(offered, 8))
        chosen = chosen.when(F.size(F.array_except(wanted, offered)) == 0, name)
    return chosen.otherwise(_hash(_lowered(deps), 12))


def environment_plan(functions: DataFrame) -> DataFrame:
    """Distinct environments with how many assets share each; counts fold before the shuffle."""
    deps = json.metadata_list(F.col("metadata"), "dependencies")
    return (
        functions.select(env_fingerprint(deps).alias("environment"), F.array_join(F.array_sort(_lowered(deps)), "|").alias("wanted"))
        .groupBy("environment")
        .agg(F.count("*").alias("assets"), F.min("wanted").alias("sample_requirements"))
    )
