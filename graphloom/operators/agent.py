"""Answering many questions at once by bounded exploration of the graph, and reading what models reply.

Questions are rows. A structural question follows a fixed plan, so all its steps are laid out by arithmetic and one join
finds what they meet. Other questions follow callees depth first: their stacks are array columns, and all of them
advance together, one join a step. A question's state is bounded by its budget of steps times the finds of a step.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.answer import EMPTY, estimated_tokens, intent
from graphloom.operators.retrieve import fulltext_batch, source_texts
from graphloom.operators.traverse import get_node, neighbors, steps
from graphloom.sources.tables import cut

# The actions of a structural question in order, the first action of any, and how others go on.
SEARCH, EXPAND, CALLERS, CALLEES = "semantic_search", "expand_dependencies", "get_callers", "get_callees"
DEPENDENCY_TYPES = ["IMPORTS", "DEPENDS_ON", "EXTENDS", "IMPLEMENTS"]


@dataclass
class GraphTools:
    """Single lookups over scoped nodes and relations; each gives at most limit nodes."""

    nodes: DataFrame
    relations: DataFrame
    chunks: DataFrame | None = None
    limit: int = 25

    def _neighbors(self, node_id: str, types: list[str] | None, direction: str) -> DataFrame:
        return neighbors(self.nodes, self.relations, node_id, types, direction, 1, self.limit)

    def callers(self, node_id: str) -> DataFrame:
        return self._neighbors(node_id, ["CALLS"], "reverse")

    def callees(self, node_id: str) -> DataFrame:
        return self._neighbors(node_id, ["CALLS"], "forward")

    def dependencies(self, node_id: str) -> DataFrame:
        return self._neighbors(node_id, DEPENDENCY_TYPES, "forward")

    def get_node(self, node_id: str) -> DataFrame:
        return get_node(self.nodes, node_id)

    def read_source(self, node_ids: DataFrame) -> DataFrame:
        """entity_id, source_text of the visible ones among node_ids (column entity_id) that have chunks."""
        if self.chunks is None:
            raise ValueError("no chunks to read")
        return source_texts(self.chunks, node_ids.join(self.nodes.select(F.col("id").alias("entity_id")), "entity_id", "left_semi"))


@dataclass(frozen=True)
class Limits:
    """steps and tokens that a question may use, the least impact of a find that counts as new, and finds of one action."""

    steps: int = 15
    tokens: int = 4096
    impact: float = 0.0
    finds: int = 25

    def __post_init__(self) -> None:
        if min(self.steps, self.tokens, self.finds) < 1:
            raise ValueError("budgets must be positive")


@dataclass(frozen=True)
class Exploration:
    """outcomes: query_id, intent, stop, n_steps, n_tokens. trace: query_id, step, action, target, n_found, prompt.

    candidates: query_id, place, node_id, name, node_type, in the order in which they were found. prompt is what a
    model is asked after the step, null where it is not asked.
    """

    outcomes: DataFrame
    trace: DataFrame
    candidates: DataFrame


def action_prompt(query: Column, action: Column) -> Column:
    return F.concat(F.lit("Domanda: "), query, F.lit("\nAzione corrente: "), action)


def _nearest(nodes: DataFrame, relations: DataFrame, types: list[str], direction: str, limits: Limits) -> DataFrame:
    """target, finds: of each visible node the visible ones one step away, the limits.finds lowest ids in order, each with whether its impact counts."""
    counts = F.coalesce(F.col("impact_score"), F.lit(0.0)) >= limits.impact if "impact_score" in nodes.columns else F.lit(limits.impact <= 0)
    seen = nodes.select(F.col("id").alias("there"), counts.alias("counts"))
    pairs = steps(relations, types, direction).where("here <> there").select("here", "there").distinct()
    pairs = pairs.join(seen, "there").join(nodes.select(F.col("id").alias("here")), "here", "left_semi")
    place = F.row_number().over(Window.partitionBy("here").orderBy("there"))  # cut on the map side, so a hub sends few rows
    kept = pairs.withColumn("place", place).where(F.col("place") <= limits.finds)
    return kept.groupBy(F.col("here").alias("target")).agg(F.array_sort(F.collect_list(F.struct(F.col("there").alias("id"), "counts"))).alias("finds"))


def explore(questions: DataFrame, nodes: DataFrame, relations: DataFrame, limits: Limits = Limits()) -> Exploration:
    """Explores the visible graph for every question (query_id, query) within its budget.

    All begin with a search. Structural ones then expand the dependencies of each seed and after that find the callers
    of each, of as many seeds as leave a step for both; without seeds one fruitless step follows. Others take the last
    node found and follow its callees. The first reason to stop that holds after a step counts: plan_completed,
    step_budget_exhausted, token_budget_exhausted, blast_radius_stabilized (from the second step on: nothing new and
    nothing left to visit). Null and blank questions stop at once with empty_question; query_id must be unique.
    """
    asked = questions.select("query_id", F.col("query"), intent(F.col("query"))["intent"].alias("intent"))
    hits = fulltext_batch(nodes, asked.where("intent IS NOT NULL").select("query_id", F.col("query").alias("text")), limits.finds)
    hits = hits.groupBy("query_id").agg(F.array_sort(F.collect_list("id")).alias("hits"))
    tokens = lambda action: estimated_tokens(action_prompt(F.col("query"), F.lit(action)))
    state = asked.join(hits, "query_id", "left").withColumn("hits", F.coalesce("hits", F.array().cast("array<string>"))).withColumn("search_tokens", tokens(SEARCH))
    state = cut(state)
    planned = _planned(state.where("intent = 'structural'"), nodes, relations, limits, tokens)
    free = _free(state.where("intent IN ('conceptual', 'hybrid')"), nodes, relations, limits, tokens)
    empty = state.where("intent IS NULL").select("query_id", "intent", F.lit("empty_question").alias("stop"), F.lit(0).alias("n_steps"), F.lit(0).alias("n_tokens"))
    found = planned.candidates.unionByName(free.candidates)
    named = found.join(nodes.select(F.col("id").alias("node_id"), "name", "node_type"), "node_id").select("query_id", "place", "node_id", "name", "node_type")
    return Exploration(planned.outcomes.unionByName(free.outcomes).unionByName(empty), planned.trace.unionByName(free.trace), named)


def _planned(state: DataFrame, nodes: DataFrame, relations: DataFrame, limits: Limits, tokens) -> Exploration:
    """Structural questions: the steps are known in advance, only their finds have to be looked up."""
    seeds = F.slice("hits", 1, (limits.steps - 1) // 2) if limits.steps > 2 else F.array().cast("array<string>")
    rows = state.select("query_id", "query", "intent", "hits", "search_tokens", seeds.alias("seeds"), tokens(EXPAND).alias("expand_tokens"), tokens(CALLERS).alias("callers_tokens"))
    n = F.size("seeds")
    step = lambda action, target: F.struct(F.lit(action).alias("action"), target.alias("target"))
    nothing = F.lit(None).cast("string")
    after = F.when(n > 0, F.concat(F.transform("seeds", lambda s: step(EXPAND, s)), F.transform("seeds", lambda s: step(CALLERS, s)))).otherwise(F.array(step(EXPAND, nothing)))
    rows = rows.withColumn("plan", F.concat(F.array(step(SEARCH, nothing)), after))
    # tokens used after the i-th step: the search, then expansions, then callers; a fruitless step uses none
    used = lambda i: F.col("search_tokens") + F.when(n > 0, F.least(i - 1, n) * F.col("expand_tokens") + F.greatest(i - 1 - n, F.lit(0)) * F.col("callers_tokens")).otherwise(0)
    spent = F.array_min(F.filter(F.sequence(F.lit(1), F.size("plan")), lambda i: used(i) >= limits.tokens))
    rows = rows.withColumn("n_steps", F.least(F.size("plan"), F.lit(limits.steps), spent))
    done = F.col("n_steps") == F.size("plan")
    stop = F.when(done & (n > 0), "plan_completed").when(F.col("n_steps") >= limits.steps, "step_budget_exhausted").when(F.col("n_steps") == spent, "token_budget_exhausted").otherwise("blast_radius_stabilized")
    rows = rows.withColumn("stop", stop).withColumn("n_tokens", used(F.col("n_steps")).cast("int"))
    taken = rows.select("query_id", "query", "hits", F.size("plan").alias("n_plan"), F.posexplode(F.slice("plan", 1, F.col("n_steps"))).alias("at", "s")).select("query_id", "query", "hits", "n_plan", (F.col("at") + 1).alias("step"), "s.action", "s.target")
    lists = _nearest(nodes, relations, DEPENDENCY_TYPES, "forward", limits).withColumn("action", F.lit(EXPAND)).unionByName(_nearest(nodes, relations, ["CALLS"], "reverse", limits).withColumn("action", F.lit(CALLERS)))
    met = taken.join(lists, ["action", "target"], "left")
    ids = F.when(F.col("action") == SEARCH, F.col("hits")).otherwise(F.coalesce(F.transform("finds", lambda x: x["id"]), F.array().cast("array<string>")))
    met = cut(met.select("query_id", "query", "n_plan", "step", "action", "target", ids.alias("found")))
    last = (F.col("step") == F.col("n_plan")) & (F.col("action") == CALLERS) & (F.size("found") > 0)
    trace = met.select("query_id", "step", "action", "target", F.size("found").alias("n_found"), F.when(last, action_prompt(F.col("query"), F.col("action"))).alias("prompt"))
    first = met.select("query_id", "step", F.posexplode("found").alias("rank", "node_id")).groupBy("query_id", "node_id").agg(F.min(F.struct("step", "rank")).alias("first"))
    # at most limits.steps * limits.finds rows a question
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("first"))
    return Exploration(rows.select("query_id", "intent", "stop", "n_steps", "n_tokens"), trace, first.select("query_id", place.alias("place"), "node_id"))


def _free(state: DataFrame, nodes: DataFrame, relations: DataFrame, limits: Limits, tokens) -> Exploration:
    """Other questions: the last node of the stack is visited; what its callees add goes on top."""
    taken = lambda step, action, target, n, prompt: F.struct(step.alias("step"), F.lit(action).alias("action"), target.alias("target"), n.alias("n_found"), prompt.alias("prompt"))
    told = lambda action, n: F.when(n > 0, action_prompt(F.col("query"), F.lit(action)))
    out_of = lambda step, used: F.when(step >= limits.steps, "step_budget_exhausted").when(used >= limits.tokens, "token_budget_exhausted")
    rows = state.select(
        "query_id", "query", "intent", tokens(CALLEES).alias("step_tokens"), F.col("hits").alias("stack"), F.col("hits").alias("found"), F.col("search_tokens").alias("n_tokens"), F.lit(1).alias("n_steps"),
        F.array(taken(F.lit(1), SEARCH, F.lit(None).cast("string"), F.size("hits"), told(SEARCH, F.size("hits")))).alias("trace"), out_of(F.lit(1), F.col("search_tokens")).alias("stop"),
    )
    lists = cut(_nearest(nodes, relations, ["CALLS"], "forward", limits))
    rows = cut(rows)
    ended = []
    for step in range(2, limits.steps + 1):
        going = rows.where("stop IS NULL")
        if going.isEmpty():
            break
        ended.append(rows.where("stop IS NOT NULL"))
        met = going.withColumn("target", F.try_element_at("stack", F.lit(-1))).join(lists, "target", "left")
        met = met.withColumn("finds", F.coalesce("finds", F.array().cast("array<struct<id: string, counts: boolean>>"))).withColumn("new", F.filter("finds", lambda x: ~F.array_contains("found", x["id"])))
        ids = F.transform("new", lambda x: x["id"])
        used = F.col("n_tokens") + F.when(F.col("target").isNotNull(), F.col("step_tokens")).otherwise(0)
        stack = F.concat(F.slice("stack", 1, F.greatest(F.size("stack") - 1, F.lit(0))), ids)
        settled = ~F.exists("new", lambda x: x["counts"]) & (F.size(stack) == 0)
        rows = met.select(
            "query_id", "query", "intent", "step_tokens", stack.alias("stack"), F.concat("found", ids).alias("found"), used.alias("n_tokens"), F.lit(step).alias("n_steps"),
            F.concat("trace", F.array(taken(F.lit(step), CALLEES, F.col("target"), F.size("finds"), told(CALLEES, F.size("finds"))))).alias("trace"),
            F.coalesce(out_of(F.lit(step), used), F.when(settled, "blast_radius_stabilized")).alias("stop"),
        )
        rows = cut(rows)
    for part in ended:
        rows = rows.unionByName(part)
    trace = rows.select("query_id", F.explode("trace").alias("t")).select("query_id", "t.*")
    found = rows.select("query_id", F.posexplode("found").alias("place", "node_id")).select("query_id", (F.col("place") + 1).alias("place"), "node_id")
    return Exploration(rows.select("query_id", "intent", "stop", "n_steps", "n_tokens"), trace, found)


def context_prompts(questions: DataFrame, candidates: DataFrame) -> DataFrame:
    """query_id, prompt: each question with a line of name, type and id for each of its candidates, in order of place."""
    line = F.format_string("- %s (%s) [%s]", F.coalesce("name", F.lit("")), F.coalesce("node_type", F.lit("")), "node_id")
    per = candidates.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))).alias("lines"))
    text = F.array_join(F.transform(F.coalesce("lines", F.array().cast("array<struct<place: int, line: string>>")), lambda x: F.concat(F.lit("\n"), x["line"])), "")
    return questions.select("query_id", "query").join(per, "query_id", "left").select("query_id", F.concat(F.lit("Domanda: "), F.col("query"), F.lit("\nContesto:"), text).alias("prompt"))


# --- replies of models --------------------------------------------------------------------------------------------


def is_fake_model(model: Column) -> Column:
    """Whether a model by its name is a stand-in; false for null."""
    return F.coalesce(F.lower(model).contains("fake"), F.lit(False))


def reply_body(reply: Column) -> Column:
    """The reply without a code fence around it."""
    return F.trim(F.regexp_replace(F.trim(reply), r"(?s)\A```[^\n]*\n(.*?)\n?```\s*\z", "$1"))


def reply_facts(replies: DataFrame) -> DataFrame:
    """query_id, kind, value of replies (query_id, reply): JSON objects whose values are strings or lists of strings.

    A kind without values has the value for emptiness. Unreadable replies, and those with other values or empty
    strings, give no rows at all.
    """
    kinds = replies.select("query_id", F.explode(F.from_json(reply_body(F.col("reply")), "map<string, variant>")).alias("kind", "raw"))
    kind = F.schema_of_variant("raw")
    values = F.when(kind == "STRING", F.array(F.try_variant_get("raw", "$", "string"))).when(kind == "ARRAY<STRING>", F.try_variant_get("raw", "$", "array<string>")).when(kind == "ARRAY<VOID>", F.when(F.try_variant_get("raw", "$[0]", "variant").isNull(), F.array(F.lit(EMPTY))))
    kinds = kinds.select("query_id", "kind", values.alias("values"))
    bad = kinds.where(F.col("values").isNull() | F.exists("values", lambda v: v.isNull() | (v == ""))).select("query_id").distinct()
    return kinds.join(bad, "query_id", "left_anti").select("query_id", "kind", F.explode("values").alias("value"))
