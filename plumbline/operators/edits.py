"""Bulk edits with before snapshots, undo, merge, split and table replacement.

Plain Parquet has no UPDATE, so every edit returns the next state of its table.  Before snapshots
are long form, one row per touched surface, never one document per edit.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from plumbline import refdata as R
from plumbline.functions import geometry as G, pricing as P, text as T
from plumbline.operators.search import ToolFilter, tool_filter
from plumbline.sources.adapters import constant_rows

c = F.col
SNAPSHOT = ["paint_type", "coats", "substrate", "status"]
#: snapshot column -> key in stored JSON
JSON_KEYS = {"paint_type": "paintType", "coats": "coats", "substrate": "substrate", "status": "status"}


@dataclass(frozen=True)
class Edit:
    """One command on the surfaces of a project, or of every project when none is named."""

    filter: ToolFilter = field(default_factory=ToolFilter)
    paint_type: str | None = None
    coats: int | None = None
    substrate: str | None = None
    status: str | None = None
    project_id: str | None = None

    def where(self) -> Column:
        cond = tool_filter(self.filter)
        return cond if self.project_id is None else cond & (c("project_id") == self.project_id)

    def changes(self) -> dict[str, object]:
        """Empty strings are ignored; a number of coats only has to be given."""
        return {k: v for k, v in (("paint_type", self.paint_type), ("coats", self.coats),
                                  ("substrate", self.substrate), ("status", self.status))
                if v is not None and v != ""}


def exclude(f: ToolFilter, project_id: str | None = None) -> Edit:
    return Edit(f, status="excluded", project_id=project_id)


def apply_edits(surfaces: DataFrame, edits: list[Edit]) -> tuple[DataFrame, DataFrame]:
    """The next state and the snapshots (edit_no, project_id, surface_id, before columns).

    Later edits see the result of earlier ones.  Everything is a chain of projections over the same
    rows, so no shuffle is needed however many edits there are.
    """
    state, marks = surfaces, []
    for no, edit in enumerate(edits, 1):
        hit = F.coalesce(edit.where(), F.lit(False))
        before = F.when(hit, F.struct(F.lit(no).alias("edit_no"), *[c(n) for n in SNAPSHOT]))
        state = state.withColumn(f"_before{no}", before)
        touched = c(f"_before{no}").isNotNull()
        state = state.withColumns({n: F.when(touched, F.lit(v)).otherwise(c(n))
                                   for n, v in edit.changes().items()})
        marks.append(f"_before{no}")
    log = state.select("project_id", "surface_id", F.inline(F.filter(
        F.array(*[c(m) for m in marks]), lambda b: b.isNotNull())))
    return state.drop(*marks), log


def audit_entries(snapshots: DataFrame, edits: list[Edit]) -> DataFrame:
    """One audit row per edit and project with its sentence."""
    n = c("affected")
    surf = F.concat(n.cast("string"), F.lit(" surface"), T.plural(n, "", "s"))
    sentence = F.lit(None).cast("string")
    for no, edit in reversed(list(enumerate(edits, 1))):
        rooms = f'in rooms matching "{edit.filter.rooms}"' if edit.filter.rooms else ""
        what = f"{edit.filter.surface_type}s" if edit.filter.surface_type else "surfaces"
        if edit.status == "excluded" and not (edit.paint_type or edit.coats or edit.substrate):
            text = F.concat(F.lit("Excluded "), surf, F.lit(" from the bid."))
        elif edit.paint_type:
            text = F.concat(F.lit("Change "), n.cast("string"), F.lit(f" {what} {rooms} to {edit.paint_type}."))
        elif edit.coats is not None:
            text = F.concat(F.lit("Change coats on "), n.cast("string"), F.lit(f" {what} {rooms} to {edit.coats}."))
        else:
            text = F.concat(F.lit("Update "), surf, F.lit("."))
        sentence = F.when(c("edit_no") == no, text).otherwise(sentence)
    return (snapshots.groupBy("edit_no", "project_id").agg(F.count(F.lit(1)).alias("affected"))
            .withColumn("action", sentence).withColumn("source", F.lit("ai")))


def set_project(projects: DataFrame, waste_pct: float | None = None, markup_pct: float | None = None,
                mode: str | None = None, project_id: str | None = None) -> DataFrame:
    """Percentages are stored as shares (K3)."""
    new = {k: v for k, v in (("waste_factor", None if waste_pct is None else waste_pct / 100),
                             ("markup", None if markup_pct is None else markup_pct / 100),
                             ("measurement_mode", mode)) if v is not None}
    hit = F.lit(True) if project_id is None else c("project_id") == project_id
    return projects.withColumns({k: F.when(hit, F.lit(v)).otherwise(c(k)) for k, v in new.items()})


def apply_assembly(surfaces: DataFrame, picks: DataFrame, assemblies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Paint and coats of an assembly for the picked surfaces.

    ``picks``: surface_id, assembly.  The audit gets one row per project and assembly with the
    number of surfaces the assembly reached in all projects; there is no snapshot, so no undo.
    """
    recipes = assemblies.select("name", c("paint_type").alias("_paint"), c("coats").alias("_coats"))
    chosen = picks.join(recipes, c("assembly") == c("name")).drop("name")
    joined = surfaces.join(chosen, "surface_id", "left")
    state = (joined.withColumn("paint_type", F.when(c("assembly").isNotNull(), c("_paint")).otherwise(c("paint_type")))
             .withColumn("coats", F.coalesce("_coats", "coats")).drop("_paint", "_coats", "assembly"))
    per_project = (joined.where(c("assembly").isNotNull()).groupBy("assembly", "project_id")
                   .agg(F.count(F.lit(1)).alias("_n")))
    total = per_project.groupBy("assembly").agg(F.sum("_n").alias("applied"))
    audit = per_project.join(total, "assembly").select(
        "project_id", F.concat(F.lit('Applied assembly "'), c("assembly"), F.lit('" to '),
                               c("applied").cast("string"), F.lit(" surface"), T.plural(c("applied"), "", "s"),
                               F.lit(".")).alias("action"))
    return state, audit


def default_assemblies(existing: DataFrame) -> DataFrame:
    """The built-in assemblies when the table is empty, else the table (K9)."""
    schema = ("name string, category string, paint_type string, coats int, production_rate double, "
              "waste_factor double, labor_rate double, paint_cost double, notes string")
    return constant_rows(existing.sparkSession, R.ASSEMBLIES, schema) if existing.isEmpty() else existing


def apply_finish_schedule(surfaces: DataFrame, schedule: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Paint by room from a specification (D8): the last matching entry wins, every match counts.

    ``schedule``: project_id, pos, room, paint_type.
    """
    key = F.lower(F.trim("room"))
    rows = schedule.where(key != "").select("project_id", key.alias("_room"), "pos", c("paint_type").alias("_paint"))
    last = rows.groupBy("project_id", "_room").agg(F.max_by("_paint", "pos").alias("_paint"),
                                                   F.count(F.lit(1)).alias("_times"))
    joined = (surfaces.withColumn("_room", F.lower(F.trim("room_label")))
              .join(last, ["project_id", "_room"], "left"))
    state = joined.withColumn("paint_type", F.when(c("_times").isNotNull(), c("_paint"))
                              .otherwise(c("paint_type"))).drop("_room", "_paint", "_times")
    counts = joined.where(c("_times").isNotNull()).groupBy("project_id").agg(F.sum("_times").alias("updated"))
    return state, counts


def update_by_ids(surfaces: DataFrame, changes: DataFrame) -> DataFrame:
    """Bulk update by id (K5, K6): ``changes`` = surface_id and any of the snapshot columns (NULL keeps)."""
    names = [n for n in SNAPSHOT if n in changes.columns]
    renamed = changes.select("surface_id", *[c(n).alias("_" + n) for n in names])
    return (surfaces.join(renamed, "surface_id", "left")
            .withColumns({n: F.coalesce("_" + n, n) for n in names}).drop(*["_" + n for n in names]))


def _json_row(row: str, names: list[str]) -> Column:
    return F.to_json(F.struct(*[c(f"{row}.{n}").alias(n) for n in names]))


def bulk_audit(surfaces: DataFrame, batches: DataFrame) -> DataFrame:
    """One audit row per batch of ids (K5, S33): batch_id, project_id, action, source, ids, after.

    ``batches``: batch_id, surface_id, and the batch's paint_type, coats, substrate, status (NULL: unchanged).  The sentence
    counts the ids that were sent; the row goes to the project of the first surface found, and a batch of unknown ids
    leaves none.  ``ids`` says how many rows the batch has in ``batches``, which stays the long form of its list.
    """
    found = batches.select("batch_id", "surface_id").join(surfaces.select("surface_id", "project_id"), "surface_id").groupBy("batch_id").agg(
        F.min_by("project_id", "surface_id").alias("project_id"))
    sent = batches.groupBy("batch_id").agg(F.count(F.lit(1)).alias("ids"), *[F.first(n, ignorenulls=True).alias(n) for n in SNAPSHOT])
    after = F.to_json(F.struct("ids", *SNAPSHOT))
    return sent.join(found, "batch_id").select(
        "batch_id", "project_id", T.bulk_action(c("ids"), c("status"), c("paint_type"), c("coats")).alias("action"),
        F.lit("user").alias("source"), "ids", after.alias("after"))


def single_audit(surfaces: DataFrame, changes: DataFrame) -> DataFrame:
    """One audit row per changed surface, with its states before and after.

    ``changes``: surface_id (once each) and any of the snapshot columns; unknown ids leave no row.
    """
    names = [n for n in SNAPSHOT if n in changes.columns]
    return changed_audit(surfaces.join(changes.select("surface_id", F.struct(*names).alias("new")), "surface_id"))


def changed_audit(rows: DataFrame) -> DataFrame:
    """``single_audit`` of surfaces that carry their change as a struct ``new`` of any of the snapshot columns."""
    names = rows.schema["new"].dataType.names
    wanted = {n: c(f"new.{n}") if n in names else F.lit(None).cast("int" if n == "coats" else "string") for n in SNAPSHOT}
    held = [n for n in rows.columns if n not in ("surface_id", "new")]
    rows = rows.select("surface_id", F.struct(*held).alias("old"), "new")
    rows = rows.withColumn("now", F.struct(*[(F.coalesce(c(f"new.{n}"), c(f"old.{n}")) if n in names else c(f"old.{n}")).alias(n) for n in held]))
    action = T.surface_action(wanted["status"], c("old.type"), c("old.room_label"), wanted["paint_type"], wanted["coats"], wanted["substrate"])
    return rows.select("surface_id", c("old.project_id").alias("project_id"), action.alias("action"), F.lit("user").alias("source"),
                       _json_row("old", held).alias("before"), _json_row("now", held).alias("after"))


def delete_surfaces(surfaces: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The kept rows and one snapshot row per removed surface."""
    gone = surfaces.join(ids.select("surface_id"), "surface_id", "left_semi")
    place = F.when(F.coalesce(c("room_label"), F.lit("")) == "", F.lit("")).otherwise(
        F.concat(F.lit(" in "), c("room_label")))
    audit = gone.select("project_id", "surface_id",
                        F.concat(F.lit("Removed a "), c("type"), place, F.lit(".")).alias("action"))
    return surfaces.join(ids.select("surface_id"), "surface_id", "left_anti"), audit


def override_pages(pages: DataFrame, overrides: DataFrame) -> DataFrame:
    """Set page type and/or visibility (K8)."""
    renamed = overrides.select("plan_page_id", c("page_type").alias("_t"), c("hidden").alias("_h"))
    return (pages.join(renamed, "plan_page_id", "left")
            .withColumn("page_type", F.coalesce("_t", "page_type"))
            .withColumn("hidden", F.coalesce("_h", "hidden")).drop("_t", "_h"))


# --- undo (D31, A3) ----------------------------------------------------------------------------
def parse_before(audit: DataFrame) -> DataFrame:
    """Stored snapshots exploded to (audit_id, pos, key set) whether an array or one object was stored.

    Unreadable text gives no rows.
    """
    text = F.trim("before")
    listed = F.when(text.startswith("{"), F.concat(F.lit("["), text, F.lit("]"))).otherwise(text)
    items = F.from_json(listed, "array<map<string,string>>")
    return audit.select("audit_id", "project_id", "action", F.posexplode(items).alias("pos", "snapshot"))


def undo(surfaces: DataFrame, projects: DataFrame, audit: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Restore surfaces and projects from the given audit entries.

    Where several of them hold the same surface, the one with the largest audit id is restored.

    Only keys that are present are written, and a present null is written as null.  A project-level
    object restores the project; elsewhere such an entry is accepted and changes nothing.
    """
    snaps = parse_before(audit)
    have = lambda key: F.map_contains_key("snapshot", key)
    per_surface = (snaps.where(have("id")).groupBy(c("snapshot.id").alias("surface_id"))
                   .agg(F.max_by("snapshot", F.struct("audit_id", "pos")).alias("snapshot")))
    restored = surfaces.join(per_surface, "surface_id", "left")
    for col, key in JSON_KEYS.items():
        restored = restored.withColumn(col, F.when(
            c("snapshot").isNotNull() & have(key), c("snapshot")[key].cast(surfaces.schema[col].dataType))
            .otherwise(c(col)))
    keys = {"waste_factor": "wasteFactor", "measurement_mode": "measurementMode", "markup": "markup",
            "overhead_pct": "overheadPct"}
    per_project = (snaps.where(~have("id")).groupBy("project_id")
                   .agg(F.max_by("snapshot", F.struct("audit_id", "pos")).alias("snapshot")))
    settled = projects.join(per_project, "project_id", "left")
    for col, key in keys.items():
        settled = settled.withColumn(col, F.when(
            c("snapshot").isNotNull() & have(key), c("snapshot")[key].cast(projects.schema[col].dataType))
            .otherwise(c(col)))
    log = audit.where(c("before").isNotNull()).select(
        "project_id", F.concat(F.lit("Undid: "), c("action")).alias("action"), F.lit("user").alias("source"))
    return restored.drop("snapshot"), settled.drop("snapshot"), log


# --- merge and split (E15, S31, K7) --------------------------------------------------------------
FIRST = ["project_id", "plan_page_id", "type", "paint_type", "coats", "substrate", "room_label", "status"]


def _merged(members: DataFrame, facts: dict[str, Column]) -> DataFrame:
    same = [F.min(n) == F.max(n) for n in ("project_id", "plan_page_id", "type")]
    return (members.groupBy("merge_id").agg(
        F.min_by(F.struct(*FIRST), "surface_id").alias("_first"), F.sum("square_footage").alias("square_footage"),
        F.sum("linear_footage").alias("linear_footage"), F.sum("count").cast("int").alias("count"),
        F.max("confidence").alias("confidence"), F.count(F.lit(1)).alias("_n"),
        (same[0] & same[1] & same[2]).alias("_same"), *[v.alias(n) for n, v in facts.items()])
        .where((c("_n") >= 2) & c("_same"))
        .select(F.concat(F.lit("merge-"), c("merge_id").cast("string")).alias("surface_id"),
                *[c(f"_first.{n}").alias(n) for n in FIRST], "square_footage", "linear_footage", "count",
                "confidence", F.lit("manual").alias("source"), "merge_id",
                F.concat(F.lit("merged from "), c("_n").cast("string"), F.lit(" surfaces")).alias("notes"), *facts))


def merge_surfaces(surfaces: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Merged rows, and the next state, for ``groups`` = merge_id, surface_id.

    A group is merged only when it has at least two surfaces of one project, page and type.
    """
    merged = _merged(surfaces.join(groups, "surface_id"), {})
    used = groups.join(merged.select("merge_id"), "merge_id", "left_semi")
    state = (surfaces.join(used.select("surface_id"), "surface_id", "left_anti")
             .unionByName(merged.drop("merge_id"), allowMissingColumns=True))
    return merged, state


def merge_members(members: DataFrame, **facts: Column) -> tuple[DataFrame, DataFrame]:
    """``merge_surfaces`` where every surface already has its one ``merge_id`` (NULL: none): nothing meets by id.

    ``facts``: more aggregates of a merge's members, which its row gets but the state does not.
    """
    merged = _merged(members.where(c("merge_id").isNotNull()), facts)
    state = (members.join(merged.select("merge_id"), "merge_id", "left_anti").drop("merge_id")
             .unionByName(merged.drop("merge_id", *facts), allowMissingColumns=True))
    return merged, state


def split_surfaces(surfaces: DataFrame, splits: DataFrame, equal: bool = False) -> DataFrame:
    """Two children per split; ``splits`` = surface_id, area_a, area_b.

    Quantities follow the areas (or halves) and are rounded separately, so counts may not add up.
    """
    share = F.lit(0.5) if equal else c("area_a") / F.greatest(c("area_a") + c("area_b"), F.lit(1e-6))
    halves = F.explode(F.array(F.struct(F.lit("a").alias("part"), share.alias("share")),
                               F.struct(F.lit("b").alias("part"), (1 - share).alias("share"))))
    part = (surfaces.join(splits, "surface_id").withColumn("_h", halves)
            .withColumn("_s", c("_h.share")))
    return part.select(
        F.concat_ws("-", "surface_id", "_h.part").alias("surface_id"), "project_id", "plan_page_id", "type",
        "paint_type", "coats", "substrate", "room_label",
        P.half_up(c("square_footage") * c("_s"), 1).alias("square_footage"),
        P.half_up(c("linear_footage") * c("_s"), 1).alias("linear_footage"),
        P.half_up(c("count") * c("_s")).cast("int").alias("count"), "confidence", "status",
        F.lit("manual").alias("source"))


def merge_requests(surfaces: DataFrame, members: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Merged rows with their drawn polygon, the next state, and one audit row per request.

    ``members``: merge_id, surface_id; ``requests``: merge_id, polygon, room_label (NULL keeps the first one's).  The first
    surface is the oldest.  Surfaces named in ``members`` that do not exist count for nothing; a request of fewer than two
    surfaces, or of several projects, pages or types, is refused: its audit row has no action but the reason.
    """
    held = ["project_id", "plan_page_id", "type", "paint_type", "coats", "substrate", "room_label", "status"]
    shared = ["project_id", "plan_page_id", "type"]
    # dealt by surface before repeats go, so that the join needs no second shuffle of the members
    found = surfaces.join(members.select("merge_id", "surface_id").repartition("surface_id").distinct(), "surface_id")
    sums = found.groupBy("merge_id").agg(
        F.min_by(F.struct(*held), F.struct("created_at", "surface_id")).alias("first"), F.sum("square_footage").alias("square_footage"),
        F.sum("linear_footage").alias("linear_footage"), F.sum("count").cast("int").alias("count"), F.max("confidence").alias("confidence"),
        F.count(F.lit(1)).alias("n"), *[(F.min(n) != F.max(n)).alias(f"_{n}") for n in shared])
    n = F.coalesce("n", F.lit(0))
    refusal = (F.when(n < 2, "fewer than two surfaces").when(c("_project_id"), "several projects").when(c("_plan_page_id"), "several pages")
               .when(c("_type"), "several types"))
    asked = requests.select("merge_id", "polygon", c("room_label").alias("_label")).join(sums, "merge_id", "left").withColumn("refused", refusal)
    done = asked.where(c("refused").isNull())
    rows = done.select(
        F.concat(F.lit("merge-"), c("merge_id").cast("string")).alias("surface_id"), *[c(f"first.{x}").alias(x) for x in held if x != "room_label"],
        F.coalesce("_label", "first.room_label").alias("room_label"), "polygon", "square_footage", "linear_footage", "count", "confidence",
        F.lit("manual").alias("source"), F.concat(F.lit("merged from "), c("n").cast("string"), F.lit(" surfaces")).alias("notes"))
    gone = found.join(done.select("merge_id"), "merge_id", "left_semi").select("surface_id").distinct()
    state = surfaces.join(gone, "surface_id", "left_anti").unionByName(rows, allowMissingColumns=True)
    action = F.when(c("refused").isNull(), F.concat(F.lit("Merged "), n.cast("string"), F.lit(" "), c("first.type"), F.lit("s into one.")))
    return rows, state, asked.select("merge_id", c("first.project_id").alias("project_id"), action.alias("action"), F.lit("user").alias("source"), "refused")


def split_requests(surfaces: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Children with polygons, labels and notes, the next state, and one audit row per split.

    ``requests``: surface_id (once each), polygons (two of them), labels (two, or NULL to keep the surface's), equal (halves
    instead of shares of the drawn areas).  Quantities are rounded for each child, so counts may not add up.
    """
    joined = surfaces.join(requests, "surface_id")
    notes = c("notes") if "notes" in surfaces.columns else F.lit(None).cast("string")
    first, second = G.area(F.get("polygons", F.lit(0))), G.area(F.get("polygons", F.lit(1)))
    share = F.when(c("equal"), 0.5).otherwise(first / F.greatest(first + second, F.lit(1e-6)))
    part = lambda i, name, of: F.struct(F.lit(name).alias("name"), F.lit(i).alias("i"), of.alias("share"))
    halves = joined.withColumn("_share", share).withColumn("_p", F.explode(F.array(part(0, "a", c("_share")), part(1, "b", 1 - c("_share")))))
    rows = halves.select(
        F.concat_ws("-", "surface_id", "_p.name").alias("surface_id"), "project_id", "plan_page_id", "type", "paint_type", "coats", "substrate",
        F.when(c("labels").isNull(), c("room_label")).otherwise(F.get("labels", c("_p.i"))).alias("room_label"), F.get("polygons", c("_p.i")).alias("polygon"),
        P.half_up(c("square_footage") * c("_p.share"), 1).alias("square_footage"), P.half_up(c("linear_footage") * c("_p.share"), 1).alias("linear_footage"),
        P.half_up(c("count") * c("_p.share")).cast("int").alias("count"), "confidence", "status", F.lit("manual").alias("source"),
        F.when(F.coalesce(notes, F.lit("")) != "", F.concat(notes, F.lit(" (split)"))).otherwise("split from another surface").alias("notes"))
    state = surfaces.join(requests.select("surface_id"), "surface_id", "left_anti").unionByName(rows, allowMissingColumns=True)
    place = F.when(F.coalesce("room_label", F.lit("")) == "", "").otherwise(F.concat(F.lit(" in "), c("room_label")))
    audit = joined.select("surface_id", "project_id", F.concat(F.lit("Split a "), c("type"), place, F.lit(" into two.")).alias("action"), F.lit("user").alias("source"))
    return rows, state, audit


def recompute_walls(surfaces: DataFrame, projects: DataFrame, proposed: bool = True,
                    accepted: bool = False) -> tuple[DataFrame, DataFrame]:
    """Wall area = length x ceiling height where it moves by at least 0.05.

    Accepted and manual walls change only on request; otherwise they are counted as affected.
    """
    joined = surfaces.join(projects.select("project_id", "ceiling_height_ft"), "project_id")
    new = P.half_up(c("linear_footage") * c("ceiling_height_ft"), 1)
    moves = (c("type") == "wall") & (c("linear_footage") > 0) & (
        c("square_footage").isNull() | (F.abs(c("square_footage") - new) >= 0.05))
    kind = F.when(c("status") == "proposed", "proposed" if proposed else None).when(
        c("status").isin("accepted", "manual"), "accepted" if accepted else "affected")
    marked = joined.withColumn("_kind", F.when(moves, kind))
    state = marked.withColumn("square_footage", F.when(c("_kind").isin("proposed", "accepted"), new)
                              .otherwise(c("square_footage"))).drop("ceiling_height_ft", "_kind")
    counts = marked.groupBy("project_id").agg(
        F.count_if(c("_kind") == "proposed").alias("recomputed_proposed"),
        F.count_if(c("_kind") == "accepted").alias("recomputed_accepted"),
        F.count_if(c("_kind") == "affected").alias("affected_accepted"))
    return state, counts


# --- takeoff persistence (B5, B6, B8, B9, B10, B12) --------------------------------------------------
def takeoff_rows(takeoff: DataFrame) -> DataFrame:
    """Surface rows of a takeoff in long form; measures that a type does not carry are NULL.

    Rows without a polygon are dropped, rows with an empty one are kept.
    """
    kind = c("type")
    return takeoff.where(c("polygon").isNotNull()).select(
        "project_id", "plan_page_id", "type", "room_label",
        F.when(~kind.isin("door", "window"), c("substrate")).alias("substrate"), "polygon",
        F.when(kind.isin("wall", "ceiling"), c("area_sqft")).alias("square_footage"),
        F.when(kind.isin("wall", "trim"), c("linear_ft")).alias("linear_footage"),
        F.when(kind.isin("door", "window"), c("count")).alias("count"), "confidence",
        F.lit("proposed").alias("status"), F.lit("ai").alias("source"),
        F.coalesce("derivation", F.lit("ai-fallback")).alias("derivation"), F.lit(2).alias("coats"))


def replace_proposed(surfaces: DataFrame, takeoff: DataFrame) -> DataFrame:
    """Drop the proposed AI surfaces of every page in the batch, then add its rows."""
    pages = takeoff.select("plan_page_id").distinct()
    stale = (c("status") == "proposed") & (c("source") == "ai")
    kept = surfaces.where(~stale).unionByName(surfaces.where(stale).join(pages, "plan_page_id", "left_anti"))
    return kept.unionByName(takeoff_rows(takeoff), allowMissingColumns=True)


def replace_wall_paths(surfaces: DataFrame, traced: DataFrame, reset: bool = False) -> DataFrame:
    """New wall paths for the traced pages; only prior AI proposals go unless ``reset``."""
    pages = traced.select("plan_page_id").distinct()
    stale = c("type") == "wall-path"
    if not reset:
        stale = stale & (c("source") == "ai") & (c("status") == "proposed")
    kept = surfaces.where(~stale).unionByName(surfaces.where(stale).join(pages, "plan_page_id", "left_anti"))
    return kept.unionByName(traced, allowMissingColumns=True)


def new_surface_defaults(rows: DataFrame) -> DataFrame:
    """Defaults of a hand-made surface."""
    source = F.coalesce("source", F.lit("manual"))
    return rows.withColumns({
        "confidence": F.lit(1.0), "coats": F.coalesce("coats", F.lit(2)),
        "status": F.coalesce("status", F.lit("manual")), "source": source,
        "derivation": F.coalesce("derivation", F.when(source == "manual", F.lit("manual")))})


def symbol_rows(counts: DataFrame) -> DataFrame:
    """One row per room of a counted symbol, or one without a room when there is no breakdown.

    Compatibility: the source is upper case ``AI`` and rows are appended, so counting a page again
    adds to the totals and a new takeoff does not remove them.
    """
    rooms = F.explode_outer("by_room")
    return counts.select("project_id", "plan_page_id", "symbol", "count", "confidence", rooms.alias("r")).select(
        "project_id", "plan_page_id", F.concat(F.lit("symbol:"), c("symbol")).alias("type"),
        c("r.room_label").alias("room_label"), F.coalesce("r.count", "count").alias("count"), "confidence",
        F.lit("AI").alias("source"))


def cascade_delete(ids: DataFrame, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """What is left of every dependent table once the projects in ``ids`` are gone."""
    gone = ids.select("project_id").distinct()
    return {name: df.join(gone, "project_id", "left_anti") for name, df in tables.items()}

