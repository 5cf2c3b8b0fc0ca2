"""Members of classes and modules, and what an attribute behind a receiver means: a join by container and name for each step of the chain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.functions.names import bare_type
from latticework.operators.ranking import first_by
from latticework.sources.shared import stored

#: Names of a receiver's chain that are followed, and functions whose results are followed from one type's name to the class.
RECEIVER_HOPS, TYPE_HOPS = 3, 3


def own_members(symbols: DataFrame) -> DataFrame:
    """container, name, member: what classes and modules declare; of a name declared again the last."""
    inside = symbols.where("scope_kind in ('class', 'module') and kind <> 'star'").select(F.col("scope_id").alias("container"), "name", "symbol_id", "file_path", "ord")
    return inside.groupBy("container", "name").agg(F.max_by("symbol_id", F.struct("file_path", "ord")).alias("member"))


def all_members(symbols: DataFrame, ancestors: DataFrame) -> DataFrame:
    """container, name, member, own: with what a class has from its nearest ancestor (node, ancestor, depth) that declares the name."""
    own = own_members(symbols)
    above = ancestors.where("node <> ancestor").join(own, F.col("ancestor") == F.col("container"))
    both = own.withColumn("depth", F.lit(0)).unionByName(above.select(F.col("node").alias("container"), "name", "member", "depth"))
    first = first_by(both, ["container", "name"], ["depth", "member"], ["member", "depth"])
    return first.select("container", "name", "member", (F.col("depth") == 0).alias("own"))


def classes_by_name(members: DataFrame, definitions: DataFrame, located: DataFrame, annotated: DataFrame) -> DataFrame:
    """module, type_name, class: what a type's name means in a module. A class is itself; a function stands for the
    class it says it returns, through TYPE_HOPS functions at most.
    """
    named = members.where("own").join(located.select(F.col("symbol_id").alias("member"), F.col("scope_kind")), "member", "left").where("coalesce(scope_kind, 'module') = 'module'")
    named = named.join(definitions.select(F.col("symbol_id").alias("member"), "definition"), "member", "left")
    named = named.select(F.col("container").alias("module"), F.col("name").alias("type_name"), F.coalesce("definition", "member").alias("meant"))
    kinds = located.select(F.col("symbol_id").alias("meant"), F.col("kind").alias("meant_kind"))
    returns = annotated.where("kind in ('function', 'method')").select(F.col("symbol_id").alias("meant"), F.col("module").alias("next_module"), F.col("type_name").alias("next_name"))
    step = named.join(kinds, "meant").join(returns, "meant", "left")
    step = step.select("module", "type_name", F.when(F.col("meant_kind") == "class", F.col("meant")).alias("class"), "next_module", "next_name")
    step = stored(step.where("class is not null or next_name is not null"), "code-types")
    onward = step.select(F.col("module").alias("next_module"), F.col("type_name").alias("next_name"), F.col("class").alias("there"), F.col("next_module").alias("then_module"), F.col("next_name").alias("then_name"))
    for _ in range(TYPE_HOPS):
        met = step.join(onward, ["next_module", "next_name"], "left")
        open_ = F.col("class").isNull()
        step = met.select("module", "type_name", F.coalesce("class", "there").alias("class"), F.when(open_, F.col("then_module")).alias("next_module"), F.when(open_, F.col("then_name")).alias("next_name"))
    return step.where("class is not null").select("module", "type_name", "class")


def containers(symbols: DataFrame, located: DataFrame, definitions: DataFrame, modules: DataFrame, members: DataFrame) -> DataFrame:
    """symbol_id, container, sure: under what the attributes of a symbol are found. Modules and classes are containers themselves, also by
    imports; a function has the class of its result, a parameter or variable that of its type, self and cls the class
    around. sure is false where the type was inferred from what is assigned.
    """
    annotated = first_by(symbols.where("annotation is not null"), ["symbol_id"], ["file_path", "ord"], ["kind", "annotation", "annotation_confidence", "module"])
    annotated = annotated.withColumn("type_name", bare_type(F.regexp_replace("annotation", "[\"']", "")))
    classes = classes_by_name(members, definitions, located, annotated)
    typed = annotated.where("kind in ('function', 'method', 'parameter', 'variable')").join(classes, ["module", "type_name"])
    typed = typed.select(F.col("symbol_id").alias("meant"), F.col("class").alias("of_type"), (F.col("annotation_confidence") == "declared").alias("type_sure"))
    around = symbols.where("kind = 'parameter' and name in ('self', 'cls')").select(F.col("symbol_id").alias("meant"), "scope_id")
    methods = symbols.where("kind = 'method'").select(F.col("symbol_id").alias("scope_id"), F.col("scope_id").alias("of_self")).distinct()
    around = around.join(methods, "scope_id").select("meant", "of_self").distinct()
    all_ = symbols.select("symbol_id").distinct().join(definitions, "symbol_id", "left").select("symbol_id", F.coalesce("definition", "symbol_id").alias("meant"))
    kinds = located.where("kind = 'class'").select(F.col("symbol_id").alias("meant"), F.col("symbol_id").alias("itself"))
    itself = kinds.unionByName(modules.select(F.col("module").alias("meant"), F.col("module").alias("itself")).distinct())
    out = all_.join(itself, "meant", "left").join(typed, "meant", "left").join(around, "meant", "left")
    found = F.coalesce("itself", "of_type", "of_self")
    return out.where(found.isNotNull()).select("symbol_id", found.alias("container"), (F.col("itself").isNotNull() | F.coalesce("type_sure", F.lit(True))).alias("sure"))


def received(refs: DataFrame, members: DataFrame, held: DataFrame, definitions: DataFrame) -> DataFrame:
    """file_path, ord, through, sure, within: what an attribute behind a receiver (root_id, receiver, name) is. The chain is followed
    name by name: the member of that name in the container, then the container that the member's type gives; the last one is asked for the
    attribute. Chains over RECEIVER_HOPS names, and those of which a step isn't known, have no row. within: by self in the class's own methods.
    """
    first = held.select(F.col("symbol_id").alias("root_id"), "container", "sure")
    at = refs.where(F.col("root_id").isNotNull() & F.col("kind").startswith("attribute-") & (F.size("receiver") <= RECEIVER_HOPS))
    at = at.select("file_path", "ord", "name", "root_id", "root_kind", "receiver").join(first, "root_id")
    here = members.select("container", F.col("name").alias("link"), "member")
    next_ = held.select(F.col("symbol_id").alias("member"), F.col("container").alias("next"), F.col("sure").alias("next_sure"))
    hop = here.join(next_, "member").select("container", "link", "next", "next_sure")
    for i in range(1, RECEIVER_HOPS):
        at = at.withColumn("link", F.get("receiver", F.lit(i))).join(hop, ["container", "link"], "left").where("link is null or next is not null")
        at = at.select("file_path", "ord", "name", "root_kind", "receiver", F.coalesce("next", "container").alias("container"), (F.col("sure") & F.coalesce("next_sure", F.lit(True))).alias("sure"))
    found = at.join(members, ["container", "name"]).join(definitions.select(F.col("symbol_id").alias("member"), "definition"), "member", "left")
    within = F.col("own") & (F.size("receiver") == 1) & F.col("receiver")[0].isin("self", "cls") & (F.col("root_kind") == "parameter")
    return found.select("file_path", "ord", F.coalesce("definition", "member").alias("through"), "sure", within.alias("within"))


def mutations(symbols: DataFrame, uses: DataFrame, mutators: tuple[str, ...]) -> DataFrame:
    """symbol_id, has_write_ref, mutator_call, escaping_read of each variable: whether its content is written to, whether a method that changes
    it is called on it by its bare name, whether it is read where it, and not only what is in it, goes on.
    """
    seen = uses.select(F.col("bound").alias("symbol_id"), F.col("kind").isin("augment", "subscript-write", "delete").alias("w"), F.lit(False).alias("m"), ((F.col("kind") == "read") & F.col("escapes")).alias("e"))
    on = uses.where("kind = 'attribute-call' and size(receiver) = 1").select(F.col("root_id").alias("symbol_id"), F.lit(False).alias("w"), F.col("name").isin(*mutators).alias("m"), F.lit(False).alias("e"))
    told = seen.unionByName(on).where("symbol_id is not null").groupBy("symbol_id").agg(F.bool_or("w").alias("w"), F.bool_or("m").alias("m"), F.bool_or("e").alias("e"))
    no = lambda c: F.coalesce(c, F.lit(False))
    return symbols.where("kind = 'variable'").select("symbol_id").distinct().join(told, "symbol_id", "left").select("symbol_id", no("w").alias("has_write_ref"), no("m").alias("mutator_call"), no("e").alias("escaping_read"))
