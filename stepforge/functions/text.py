"""Text column functions: actions, triples, observations, phrases, chat."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters stripped from the ends of an action.
ACTION_EDGES = "\"'`., \t\n"
# Bracketed verbs and their plain names.
VERBS = {"WALK": "walk", "GRAB": "grab", "OPEN": "open", "SWITCHON": "switchon", "PUTBACK": "put", "PUTIN": "putin"}
# Natural-language beginnings of an action, in the order in which they are tried.
PREFIXES = [
    ("switch on", "switchon"), ("switchon", "switchon"), ("turn on", "switchon"), ("switch", "switchon"),
    ("put in", "putin"), ("putin", "putin"), ("place in", "putin"),
    ("put back", "put"), ("put on", "put"), ("put", "put"),
    ("walk to", "walk"), ("go to", "walk"), ("walk", "walk"),
    ("grab", "grab"), ("take", "grab"), ("pick up", "grab"), ("open", "open"),
]
# Rooms under other names.
ROOMS = {"dining_room": "kitchen", "home_office": "livingroom", "living_room": "livingroom"}
# Object states that an observation shows.
STATES = {"OPEN": "open", "CLOSED": "closed", "ON": "on", "OFF": "off", "PLUGGED_IN": "plugged_in", "PLUGGED_OUT": "plugged_out"}

# Bracketed verbs of a model's answer that have another plain name.
ANSWER_VERBS = {"putback": "put"}
# Words between the two objects of an action, in the order in which they are tried.
BETWEEN = ["into", "in", "onto", "on", "to"]
# The classes that a room's name may stand for, in the order in which they are tried.
ROOM_CLASSES = {
    "livingroom": ["livingroom", "living_room", "home_office"], "living room": ["livingroom", "living_room", "home_office"],
    "kitchen": ["kitchen", "dining_room"], "dining room": ["dining_room", "kitchen"], "bathroom": ["bathroom"], "bedroom": ["bedroom", "kids_bedroom"],
}
# Fixed value: the form of a triple.
TRIPLE = r"\(([^,]+),\s*([^,]+),\s*([^)]+)\)"


def mapped(key: Column, values: dict[str, str], otherwise: Column | None = None) -> Column:
    table = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    return F.coalesce(F.try_element_at(table, key), key if otherwise is None else otherwise)


def normalised_action(x: Column) -> Column:
    """Trimmed, lower case, without quotes, dots and commas at the ends, white space as one space."""
    return F.trim(F.regexp_replace(F.trim(F.lower(F.trim(x)), F.lit(ACTION_EDGES)), r"\s+", " "))


def script_action(x: Column) -> Column:
    """`[VERB] <a> (1) <b> (2)` as `verb a b`; a line that does not begin with a verb in brackets stays, trimmed."""
    verb = F.regexp_extract(x, r"^\s*\[([A-Z_]+)\]", 1)
    names = F.regexp_extract_all(F.regexp_replace(x, r"^\s*\[[A-Z_]+\]", ""), F.lit(r"<([^>]+)>"), 1)
    return F.when(verb == "", F.regexp_replace(x, r"^\s+|\s+$", "")).otherwise(F.array_join(F.concat(F.array(mapped(verb, VERBS, F.lower(verb))), names), " "))


def action_words(x: Column) -> Column:
    return F.filter(F.split(F.trim(x), r"\s+"), lambda w: w != "")


def phrase_tokens(x: Column) -> Column:
    """Lower-case words without underscores, other characters and articles."""
    plain = F.regexp_replace(F.replace(F.lower(x), F.lit("_"), F.lit(" ")), r"[^a-z0-9 ]", " ")
    return F.filter(F.split(plain, r"\s+"), lambda w: (w != "") & ~w.isin("a", "an", "the"))


def cleaned_prediction(x: Column) -> Column:
    """What a model's answer says to do: after its last `action:`, the first line, up to a separator."""
    plain = F.trim(F.replace(x, F.lit("`"), F.lit("")))
    after = F.regexp_replace(plain, r"(?is)^.*action:\s*", "")
    return F.trim(F.regexp_extract(F.trim(after), r"^([^\n;|\t]*)", 1))


def parsed_action(x: Column) -> Column:
    """Struct (verb, rest) of a natural-language action by the first prefix that ends at a word; nulls without one."""
    text = normalised_action(x)

    def chain(pick) -> Column:
        tests = [((text == p) | text.startswith(p + " "), pick(p, v)) for p, v in PREFIXES]
        return reduce(lambda w, t: w.when(*t), tests[1:], F.when(*tests[0]))

    verb = chain(lambda p, v: F.lit(v))
    rest = chain(lambda p, v: F.trim(F.substring(text, len(p) + 1, 1 << 30)))
    inside = (verb == "put") & F.contains(F.concat(F.lit(" "), rest, F.lit(" ")), F.lit(" in "))
    return F.struct(F.when(inside, "putin").otherwise(verb).alias("verb"), rest.alias("rest"))


def parsed_command(x: Column) -> Column:
    """Struct (verb, args) of a model's answer: `[VERB] <a> (1) <b> (2)`, or a natural-language action, whose rest is its one argument."""
    line = cleaned_prediction(x)
    bracket = F.replace(F.lower(F.regexp_extract(line, r"^\s*\[([A-Za-z_]+)\]", 1)), F.lit("_"), F.lit(""))
    names = F.regexp_extract_all(F.regexp_replace(line, r"^\s*\[[A-Za-z_]+\]", ""), F.lit(r"<([^>]+)>"), 1)
    said = parsed_action(line)
    rest = F.when(said["verb"].isNull(), F.lit(None)).when(said["rest"] == "", F.array().cast("array<string>")).otherwise(F.array(said["rest"]))
    return F.struct(F.when(bracket != "", mapped(bracket, ANSWER_VERBS)).otherwise(said["verb"]).alias("verb"), F.when(bracket != "", names).otherwise(rest).alias("args"))


def triples(x: Column) -> Column:
    """Distinct (s, r, o) structs of `(s, r, o), ...`, in order of appearance."""
    one = lambda m, i: F.trim(F.regexp_extract(m, TRIPLE, i))
    return F.array_distinct(F.transform(F.regexp_extract_all(x, F.lit(TRIPLE), 0), lambda m: F.struct(one(m, 1).alias("s"), one(m, 2).alias("r"), one(m, 3).alias("o"))))


def triple_texts(x: Column) -> Column:
    """The `(…)` parts of a state text, or the whole text without any."""
    found = F.transform(F.regexp_extract_all(x, F.lit(r"\(([^()]*)\)"), 1), lambda m: F.concat(F.lit("("), F.trim(m), F.lit(")")))
    return F.when(F.size(found) > 0, found).otherwise(F.array(x))


def sentences(x: Column) -> Column:
    """Lines, and within them parts after `.`, `!` or `?` and white space; empty parts are left out. A text without parts is its own part, an empty or null one has none."""
    lines = F.split(x, r"\R")
    parts = F.flatten(F.transform(lines, lambda line: F.split(line, r"(?<=[.!?])\s+")))
    found = F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != "")
    return F.when(F.coalesce(x, F.lit("")) == "", F.array().cast("array<string>")).when(F.size(found) > 0, found).otherwise(F.array(x))


def rendered_triples(items: Column) -> Column:
    """`(s, r, o), ...` of an array of structs, distinct and sorted by code point."""
    return F.array_join(F.transform(F.array_sort(F.array_distinct(items)), lambda t: F.concat(F.lit("("), t["s"], F.lit(", "), t["r"], F.lit(", "), t["o"], F.lit(")"))), ", ")


def after_last(x: Column, marker: str) -> Column:
    return F.substring_index(x, marker, -1)


def first_line(x: Column) -> Column:
    """The first line that is not blank, trimmed; empty without one."""
    return F.trim(F.regexp_extract(x, r"\A\s*([^\n\r]*)", 1))


def goal_visible(observation: Column, family: Column, args: Column) -> Column:
    """Whether an observation shows the triple that a task makes true; false for a family without one."""
    return F.coalesce(F.array_contains(triples(observation), goal(family, args)), F.lit(False))


def before_first(x: Column, marker: str) -> Column:
    return F.substring_index(x, marker, 1)


def rendered_chat(messages: Column) -> Column:
    """Messages (role, content) in a fixed template."""
    return F.array_join(F.transform(messages, lambda m: F.concat(F.lit("<|"), m["role"], F.lit("|>"), m["content"], F.lit("<|end|>"))), "")


# The sentences of the task families, and their goals, in the three functions below.
def instruction(family: Column, args: Column) -> Column:
    """The sentence that asks for a task of a family."""
    name = lambda i: F.replace(F.get(args, F.lit(i)), F.lit("_"), F.lit(" "))
    return (
        F.when(family == "turnon", F.concat(F.lit("Turn on "), name(0)))
        .when(family == "open", F.concat(F.lit("Open "), name(0)))
        .when(family == "puton", F.concat(F.lit("Put "), name(0), F.lit(" on "), name(1)))
        .when(family == "placein", F.concat(F.lit("Place "), name(0), F.lit(" in "), name(1)))
    )


def goal(family: Column, args: Column) -> Column:
    """The triple that a task of a family makes true."""
    a, b = F.get(args, F.lit(0)), F.get(args, F.lit(1))
    make = lambda s, r, o: F.struct(s.alias("s"), F.lit(r).alias("r"), o.alias("o"))
    return F.when(family == "turnon", make(a, "is", F.lit("on"))).when(family == "open", make(a, "is", F.lit("open"))).when(family == "puton", make(a, "on", b)).when(family == "placein", make(a, "inside", b))


def task_family(text: Column) -> Column:
    """The family that an instruction belongs to; null if none."""
    low = F.lower(text)
    return (
        F.when(low.startswith("turn on "), "turnon")
        .when(low.startswith("open "), "open")
        .when(low.startswith("put ") & F.contains(low, F.lit(" on ")), "puton")
        .when(low.startswith("place ") & F.contains(low, F.lit(" in ")), "placein")
    )


# What stands around a model's answer.
SPEAKER, ANSWER_START, ANSWER_END = "assistant", "<|end_header_id|>", "<|eot_id|>"


def decoded_action(x: Column, strict: bool = False) -> Column:
    """The first line of a decoded answer: behind the last SPEAKER, then behind the first ANSWER_START, before the first ANSWER_END.

    An answer without any text gives an empty line, or with strict an error."""
    said = F.element_at(F.split(after_last(x, SPEAKER), r"\Q" + ANSWER_START + r"\E", 2), -1)
    line = first_line(F.substring_index(said, ANSWER_END, 1))
    return F.when(F.coalesce(line, F.lit("")) == "", F.raise_error(F.lit("an answer without an action"))).otherwise(line) if strict else line
