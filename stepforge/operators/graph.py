"""Scene graphs as tables of nodes and edges: observations, containment, plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepforge.functions.text import ROOMS, STATES, mapped, rendered_triples
from stepforge.session import cut

# Categories that are no objects.
NOT_OBJECTS = ("Floor", "Walls", "Ceiling", "Doors")


def observations(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """scene, observation: the distinct, sorted triples of states and relations that the agent sees.

    nodes (scene, pos, id, class_name, category, states), edges (scene, from_id, to_id, relation_type)."""
    named = nodes.filter(~F.coalesce(F.col("category").isin(*NOT_OBJECTS), F.lit(False)))
    agents = nodes.filter(F.col("category") == "Characters").groupBy("scene").agg(F.min_by("id", "pos").alias("agent"))
    triple = lambda s, r, o: F.struct(s.alias("s"), r.alias("r"), o.alias("o"))
    states = named.select("scene", "class_name", F.explode("states").alias("state")).select("scene", triple(F.col("class_name"), F.lit("is"), mapped(F.col("state"), STATES, F.lit(None).cast("string"))).alias("t")).filter("t.o is not null")
    side = lambda p, i: named.select("scene", F.col("id").alias(i), F.col("class_name").alias(f"{p}_name"), F.coalesce(F.col("category") == "Rooms", F.lit(False)).alias(f"{p}_room"))
    both = edges.join(side("s", "from_id"), ["scene", "from_id"]).join(side("o", "to_id"), ["scene", "to_id"]).join(agents, "scene", "left")
    s, o, kind, own = F.col("s_name"), F.col("o_name"), F.col("relation_type"), F.coalesce(F.col("from_id") == F.col("agent"), F.lit(False))
    o_room = F.when(F.col("o_room"), mapped(o, ROOMS)).otherwise(o)
    t = (
        F.when(kind == "INSIDE", triple(s, F.lit("inside"), o_room))
        .when(kind == "ON", triple(s, F.lit("on"), o))
        .when((kind == "CLOSE") & own, triple(s, F.lit("close"), o))
        .when(kind.isin("HOLDS_RH", "HOLDS_LH") & own, triple(s, F.lit("hold"), o))
        .when((kind == "BETWEEN") & F.col("s_room") & F.col("o_room"), triple(mapped(s, ROOMS), F.lit("adjacent"), mapped(o, ROOMS)))
    )
    relations = both.select("scene", t.alias("t")).filter("t is not null")
    holding = edges.filter(kind.isin("HOLDS_RH", "HOLDS_LH")).join(agents, "scene").filter("from_id = agent").select("scene").distinct()
    empty = agents.join(holding, "scene", "left_anti").select("scene", triple(F.lit("character"), F.lit("hold"), F.lit("none")).alias("t"))
    all_ = states.unionByName(relations).unionByName(empty)
    seen = all_.groupBy("scene").agg(rendered_triples(F.collect_set("t")).alias("observation"))
    return nodes.select("scene").distinct().join(seen, "scene", "left").select("scene", F.coalesce("observation", F.lit("")).alias("observation"))


def has_relation(nodes: DataFrame, edges: DataFrame, subject: str, relation: str, object_: str) -> DataFrame:
    """scene, holds: whether some subject node stands in the relation to some object node."""
    of = lambda name, i: nodes.filter(F.col("class_name") == name).select("scene", F.col("id").alias(i))
    hits = edges.filter(F.col("relation_type") == relation).join(of(subject, "from_id"), ["scene", "from_id"], "left_semi").join(of(object_, "to_id"), ["scene", "to_id"], "left_semi")
    return nodes.select("scene").distinct().join(hits.select("scene", F.lit(True).alias("_h")).distinct(), "scene", "left").select("scene", F.coalesce("_h", F.lit(False)).alias("holds"))


def held_objects(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """scene, held: the class at the end of the first edge by which a character holds a node; null where nothing is held.

    nodes (scene, id, class_name), edges (scene, pos, from_id, to_id, relation_type)."""
    own = nodes.select("scene", "id", "class_name")
    holds = edges.filter(F.col("relation_type").isin("HOLDS_RH", "HOLDS_LH"))
    of = holds.join(own.filter("class_name = 'character'").select("scene", F.col("id").alias("from_id")), ["scene", "from_id"], "left_semi")
    of = of.join(own.withColumnRenamed("id", "to_id"), ["scene", "to_id"]).groupBy("scene").agg(F.min_by("class_name", "pos").alias("held"))
    return nodes.select("scene").distinct().join(of, "scene", "left")


def has_state(nodes: DataFrame, name: str, state: str) -> DataFrame:
    """scene, holds: whether some node of the class has the state."""
    one = (F.col("class_name") == name) & F.exists("states", lambda s: F.upper(s) == state)
    return nodes.groupBy("scene").agg(F.coalesce(F.bool_or(one), F.lit(False)).alias("holds"))


def chains(steps: DataFrame) -> tuple[DataFrame, int]:
    """node, to, steps: for steps (node, to), one for each node, the first node on its way that has no step of its own, and how many rounds it took.

    Pointers are doubled: a round joins each pointer to the pointer of its end, so ways of length d take log2(d) rounds and one that finds nothing open. Nodes whose
    pointer is still open when it is longer than there are nodes run in a cycle, or into one, and have no row."""
    now, rounds, left = steps.select("node", "to", F.lit(1).cast("long").alias("steps"), F.lit(False).alias("open")), 0, 1
    most = None
    while left and (most is None or 1 << (rounds - 1) <= most):
        on = now.select(F.col("node").alias("to"), F.col("to").alias("then"), F.col("steps").alias("more"))
        now = cut(now.join(on, "to", "left").select("node", F.coalesce("then", "to").alias("to"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.col("then").isNotNull().alias("open")))
        most, left = now.agg(F.count("*"), F.count_if("open")).first()
        rounds += 1
    return now.filter("not open").drop("open"), rounds


def containment_roots(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """node, root, depth: the nearest of roots (node) that each child of edges (child, parent) lies in, the least name of equally near ones.

    Nodes with one parent are jumped over by pointer doubling, in rounds that grow with the logarithm of their depth. What is left, nodes with several
    parents, is relaxed over the jumps, a round for each of them on the longest way; cycles end by themselves."""
    tops = roots.select("node", F.col("node").alias("root"), F.lit(0).cast("long").alias("depth")).distinct()
    below = edges.select("child", "parent").distinct().join(tops.select(F.col("node").alias("child")), "child", "left_anti")  # a root is its own, whatever it lies in
    count = cut(below.groupBy("child").agg(F.collect_set("parent").alias("parents")))
    one, several = F.size("parents") == 1, count.filter(F.size("parents") > 1).select("child", F.explode("parents").alias("parent"))
    jumps, _ = chains(count.filter(one).select(F.col("child").alias("node"), F.col("parents")[0].alias("to")))
    known = tops
    if not several.isEmpty():
        over = jumps.select(F.col("node").alias("parent"), F.col("to").alias("end"), "steps")
        ways = cut(several.join(over, "parent", "left").select("child", F.coalesce("end", "parent").alias("to"), (1 + F.coalesce("steps", F.lit(0))).alias("steps")))
        best, seen = F.min(F.struct("depth", "root")).alias("best"), None
        while True:
            reached = ways.join(known, F.col("to") == F.col("node")).select(F.col("child").alias("node"), "root", (F.col("depth") + F.col("steps")).alias("depth"))
            known = cut(tops.unionByName(reached).groupBy("node").agg(best).select("node", "best.root", "best.depth"))
            now = known.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("node", "root", "depth"), F.lit(1 << 40)))).first()
            if now == seen:
                break
            seen = now
    by_jump = jumps.join(known.select(F.col("node").alias("to"), "root", "depth"), "to").select("node", "root", (F.col("depth") + F.col("steps")).alias("depth"))
    return known.join(edges.select(F.col("child").alias("node")).distinct(), "node", "left_semi").unionByName(by_jump)


def best_nodes(nodes: DataFrame, by: list[str], order: list) -> DataFrame:
    """Per group the node that comes first by order (columns, descending worth) and then by least id."""
    worth = F.struct(*[c.alias(f"w{i}") for i, c in enumerate(order)], (-F.col("id")).alias("id"))
    return nodes.groupBy(*by).agg(F.max_by("id", worth).alias("id"))


def plan_steps(tasks: DataFrame) -> DataFrame:
    """task_id, steps: the actions of a task, joined by `; `; steps without a known place are left out.

    tasks (task_id, family, object, object_room, object_inside, target, target_room, target_closed)."""
    walk = lambda c: F.when(F.col(c).isNotNull(), F.concat(F.lit("walk "), F.col(c)))
    do = lambda verb, c, when=None: F.when(F.col(c).isNotNull() & (F.lit(True) if when is None else when), F.concat(F.lit(f"{verb} "), F.col(c)))
    two = F.col("family").isin("puton", "placein")
    steps = [
        walk("object_room"),
        walk("object_inside"),
        do("open", "object_inside"),
        walk("object"),
        F.when(F.col("family") == "turnon", do("switchon", "object")),
        F.when(F.col("family") == "open", do("open", "object")),
        F.when(two, do("grab", "object")),
        F.when(two, walk("target_room")),
        F.when(two, walk("target")),
        F.when((F.col("family") == "placein") & F.col("target_closed"), do("open", "target")),
        F.when(F.col("family") == "puton", F.concat(F.lit("put "), F.col("object"), F.lit(" "), F.col("target"))),
        F.when(F.col("family") == "placein", F.concat(F.lit("putin "), F.col("object"), F.lit(" "), F.col("target"))),
    ]
    return tasks.select("task_id", F.array_join(F.array_compact(F.array(*steps)), "; ").alias("steps"))
