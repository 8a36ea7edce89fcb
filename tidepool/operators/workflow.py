"""Data-side state machines: feedback and triage, review drafts, exports, last user turn, listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidepool.operators.ranking import ranked

#: What a reason of unhelpful feedback is filed under.
CATEGORIES = {
    "incorrect_answer": "generation_grounding", "missing_evidence": "retrieval_miss", "irrelevant_evidence": "rerank_error",
    "citation_problem": "generation_grounding", "outdated_information": "knowledge_stale_or_conflict", "other": "product_or_bug",
}
TERMINAL = ("resolved", "dismissed")


def category(reason: Column) -> Column:
    """What a reason is filed under; null for one that isn't known."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in CATEGORIES.items() for x in kv]), reason)


def accepted(feedback: DataFrame) -> DataFrame:
    """Feedback with a known reason if it is unhelpful and with none if it is helpful; the rest is refused."""
    known = F.coalesce(F.col("reason").isin(*CATEGORIES), F.lit(False))
    return feedback.where((~F.col("helpful") & known) | (F.col("helpful") & F.col("reason").isNull()))


def triage(feedback: DataFrame, ts: str = "ts", order: str = "event_id") -> DataFrame:
    """(answer_id, state, opened, category) after all feedback: unhelpful opens or reopens, helpful dismisses what is open.

    The state depends on the last event and the category on the last unhelpful one, so no fold over the log is needed.
    """
    at, bad = F.struct(ts, order), ~F.col("helpful")
    per = feedback.groupBy("answer_id").agg(
        F.max_by("helpful", at).alias("_helpful"), F.max_by(category(F.col("reason")), F.when(bad, at)).alias("category"), F.count_if(bad).alias("opened"))
    return per.where("opened > 0").select("answer_id", F.when(F.col("_helpful"), "dismissed").otherwise("open").alias("state"), "opened", "category")


def review(items: DataFrame) -> DataFrame:
    """Adds error for reviews that are refused: a terminal state stays, and resolving needs a target."""
    error = F.when(F.col("state").isin(*TERMINAL), "TERMINAL_STATE").when((F.col("to") == "resolved") & F.col("target").isNull(), "TARGET_REQUIRED")
    return items.withColumn("error", error).withColumn("state", F.when(error.isNull(), F.col("to")).otherwise(F.col("state")))


def new_drafts(triaged: DataFrame, drafts: DataFrame, target: str) -> DataFrame:
    """Resolved items of the target that have no draft yet."""
    return triaged.where((F.col("state") == "resolved") & (F.col("target") == target)).join(drafts.select("item_id"), "item_id", "left_anti")


def export_cases(cases: DataFrame, limit: int) -> DataFrame:
    """Approved cases, oldest first, with distinct titles and keywords that aren't empty."""
    clean = lambda c: F.array_distinct(F.filter(F.transform(c, lambda t: F.trim(t)), lambda t: t != "")).alias(c)
    approved = cases.where("state = 'approved'").orderBy("created_at", "case_id").limit(limit)
    return approved.select("case_id", "created_at", clean("titles"), clean("keywords"))


def last_user_turn(messages: DataFrame) -> DataFrame:
    """Assistant messages with the latest user turn before them in the conversation (as-of join by a window)."""
    own = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    asked = F.last(F.when(F.col("role") == "user", F.struct(F.col("turn").alias("turn"), F.col("text").alias("text"))), ignorenulls=True).over(own)
    out = messages.withColumn("_asked", asked).where("role = 'assistant'")
    return out.select("conv_id", "turn", F.col("_asked.turn").alias("user_turn"), F.col("_asked.text").alias("user_text"))


def page(df: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """One page with the total on every row. The count is one aggregate, not a window over everything."""
    total = df.agg(F.count("*").alias("total"))
    return df.orderBy(*order).offset(offset).limit(limit).join(F.broadcast(total))


def latest(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    return ranked(df, by, order, "_n").where("_n = 1").drop("_n")


def sequence(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    return ranked(df, by, order, "sequence")


# --- proposals, governance edits, members -------------------------------------------------------------------


def decide_proposals(proposals: DataFrame, as_of: Column) -> DataFrame:
    """Adds error to decisions that are refused and moves the others on.

    proposals: state, decision (approved or rejected), expires_at, role, required_role, expected_version, version.
    """
    rank = lambda c: F.array_position(F.array(*map(F.lit, ("viewer", "editor", "approver", "owner"))), F.col(c))
    error = (F.when(F.col("state") != "pending", "NOT_PENDING").when(F.col("expires_at") <= as_of, "EXPIRED")
             .when(rank("role") < rank("required_role"), "ROLE_REQUIRED").when(F.col("expected_version") != F.col("version"), "VERSION_CONFLICT"))
    state = F.when(error.isNull(), F.col("decision")).when(error == "EXPIRED", "expired").otherwise(F.col("state"))
    return proposals.withColumn("error", error).withColumn("state", state)


def edit_governance(documents: DataFrame, edits: DataFrame) -> DataFrame:
    """Checks edits and raises the version of those that hold.

    edits: document_id, expected_version, effective_at, expires_at, supersedes_document_id. A predecessor has to be
    another document of the same knowledge base that isn't archived.
    """
    own = documents.select("document_id", F.col("kb_id").alias("_kb"), F.col("status").alias("_status"), "governance_version")
    other = documents.where("status <> 'archived'").select(F.col("document_id").alias("supersedes_document_id"), F.col("kb_id").alias("_other"))
    met = edits.join(own, "document_id", "left").join(other, "supersedes_document_id", "left")
    error = (F.when(F.col("_status").isNull() | (F.col("_status") == "archived"), "NOT_FOUND")
             .when(F.col("governance_version") != F.col("expected_version"), "VERSION_CONFLICT")
             .when(F.col("effective_at") >= F.col("expires_at"), "DATES")
             .when(F.col("supersedes_document_id") == F.col("document_id"), "SUPERSEDES_ITSELF")
             .when(F.col("supersedes_document_id").isNotNull() & ~F.col("_other").eqNullSafe(F.col("_kb")), "PREDECESSOR"))
    version = F.col("governance_version") + F.when(error.isNull(), 1).otherwise(0)
    return met.withColumn("error", error).withColumn("governance_version", version).drop("_kb", "_status", "_other")


def change_members(members: DataFrame, changes: DataFrame) -> DataFrame:
    """Applies role and state changes (null: as it is); a workspace keeps an active owner, or all its changes are refused."""
    met = members.join(changes.select("workspace_id", "user_id", F.col("role").alias("_role"), F.col("state").alias("_state")), ["workspace_id", "user_id"], "left")
    role, state = F.coalesce("_role", "role"), F.coalesce("_state", "state")
    owners = F.sum(((role == "owner") & (state == "active")).cast("int")).over(Window.partitionBy("workspace_id"))
    met = met.withColumn("_owners", owners)
    kept = F.col("_owners") > 0
    out = met.select("workspace_id", "user_id", F.when(kept, role).otherwise(F.col("role")).alias("role"), F.when(kept, state).otherwise(F.col("state")).alias("state"),
                     F.when(~kept & (F.col("_role").isNotNull() | F.col("_state").isNotNull()), "LAST_OWNER").alias("error"))
    return out


def decide_tags(assignments: DataFrame, decisions: DataFrame) -> DataFrame:
    """Pending assignments become approved or rejected; the others stay."""
    met = assignments.join(decisions.select("assignment_id", "decision"), "assignment_id", "left")
    return met.withColumn("state", F.when((F.col("state") == "pending") & F.col("decision").isin("approved", "rejected"), F.col("decision")).otherwise(F.col("state"))).drop("decision")


# --- mind maps ----------------------------------------------------------------------------------------------

POINT_SPACING, THEME_GAP = 70, 46


def mind_map_layout(themes: DataFrame) -> DataFrame:
    """Heights of the nodes of each map, centred: (map_id, theme, point, y), point null for the theme itself.

    themes: map_id, theme (from 0), points (array). A running sum over the themes of a map gives where each begins.
    """
    height = F.size("points") * POINT_SPACING + THEME_GAP
    before = F.sum(height).over(Window.partitionBy("map_id").orderBy("theme")) - height
    total = F.sum(height).over(Window.partitionBy("map_id"))
    at = themes.withColumn("_y", before - total / 2)
    heads = at.select("map_id", "theme", F.lit(None).cast("int").alias("point"), (F.col("_y") + (F.size("points") - 1) * POINT_SPACING / 2).alias("y"))
    points = at.select("map_id", "theme", F.posexplode("points").alias("point", "_t"), "_y")
    return heads.unionByName(points.select("map_id", "theme", "point", (F.col("_y") + F.col("point") * POINT_SPACING).alias("y")))
