"""Operators of the knowledge pipelines: upload, consolidation, segmentation, labelling, evolution, export, merging."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.config import DEFAULTS
from sparkloom.functions import messages as M
from sparkloom.functions import text as T
from sparkloom.operators.ranking import global_rank
from sparkloom.operators.similarity import best_match, nearest_duplicate
from sparkloom.scratch import discard, saved
from sparkloom.sources.sessions import slices

EMBED_DIMS = 64


def embed(text: Column, dims: int = EMBED_DIMS) -> Column:
    """Stand-in for an embedding service: signed hashed words, scaled to length 1; zeros for a text without words.

    An Arrow UDF over batches, as a client of a real service would be; any column function from text to
    array<double> takes its place wherever an embedder is an argument.
    """

    @F.arrow_udf("array<double>")
    def run(column: pa.Array) -> pa.Array:
        out = np.zeros((len(column), dims))
        for i, t in enumerate(column.to_pylist()):
            for w in re.findall(r"\w+", (t or "").lower()):
                h = hashlib.md5(w.encode()).digest()
                out[i, (h[0] << 8 | h[1]) % dims] += 1.0 if h[2] & 1 else -1.0
        n = np.linalg.norm(out, axis=1, keepdims=True)
        out = out / np.where(n > 0, n, 1)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(column) + 1, dtype=np.int32) * dims), pa.array(out.ravel()))

    return run(text)


def decoded_tags(text: Column) -> Column:
    """Tags from JSON text; bad or missing text is no tags."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


def decoded_vector(vector: Column) -> Column:
    """A vector as array<double>, missing ones empty."""
    return F.coalesce(vector.cast("array<double>"), F.array().cast("array<double>"))


def upload(new: DataFrame, existing: DataFrame, soft: float = DEFAULTS.dedup_soft, hard: float = DEFAULTS.dedup_hard, embedder=embed, confirm=None, classifier=None, order: tuple[str, ...] = ("new_id",)) -> DataFrame:
    """What becomes of each row of new(new_id, content, context, resolution), taken one after the other by `order`.

    Fields are sanitised, typed and embedded. A row's candidates are the memories of its type that exist or were inserted for a row
    before it; the most similar at `soft` is its nearest (ties: hot, warm, cold, then those inserted; then the first).
    A nearest at `hard` takes the row as a hit (action merge); one below does so only if confirm says so, a column function of
    its content and context and the row's. Else the row is inserted as warm. Result: new with sanitised fields, memory_type,
    embedding, action, sim, and the nearest as id (an existing one) or earlier_id (a new row's); of a merge that is duplicate_of or
    duplicate_of_new. A merge changes no candidate's vector within the call. Further columns of new are kept.

    Rows that no undecided row before them can matter to are decided in rounds, as many as the longest chain of rows that wait for each
    other. A round compares the undecided rows with one another in blocks and keeps one candidate a row, so that a group of equal rows
    never becomes pairs. The first compares all of them, and only rows whose most similar row before them was not inserted are compared again.
    """
    clean = new.withColumns({c: T.sanitize(F.col(c)) for c in ("content", "context", "resolution")})
    kind = T.typed(F.col("content"), F.col("context"), F.col("resolution"), classifier)
    vec = lambda d: d.withColumn("embedding", embedder(T.embed_input(F.col("memory_type"), F.col("content"), F.col("context"), F.col("resolution"))))
    # Written before they are numbered, as the ranges of the order are drawn from all rows: texts are cleaned and embedded once.
    made = saved(vec(clean.withColumn("memory_type", kind)), "upload-made")
    rows = global_rank(made, [F.col(c) for c in order], "__place")
    discard(made)
    old = existing
    if "embedding" not in existing.columns:
        # Texts go on only where a confirmation reads them.
        old = saved(vec(existing).select("id", "memory_type", "tier", "status", "embedding", *(["content", "context"] if confirm else [])), "upload-old")
    vectors = rows.select("__place", "memory_type", "embedding")
    best_old = nearest_duplicate(vectors.withColumnRenamed("__place", "new_id"), old, soft).select(F.col("new_id").alias("__place"), F.col("id").alias("old_id"), F.col("sim").alias("old_sim"))
    best_old = saved(best_old, "upload-nearest")
    left = saved(vectors.join(best_old.select("__place", "old_id", "old_sim"), "__place", "left").withColumns({"new_place": F.lit(None).cast("long"), "new_sim": F.lit(None).cast("double")}), "upload-open")
    inserted: DataFrame | None = None
    found: DataFrame | None = None
    sure = F.greatest("old_sim", "new_sim")

    def before(ours: DataFrame, theirs: DataFrame, least: float) -> DataFrame:
        """(__place, other, sim): the most similar of theirs that comes before each of ours."""
        found = best_match(ours.select("memory_type", F.col("__place").alias("left_id"), "embedding"), theirs.select("memory_type", F.col("__place").alias("right_id"), F.lit(0).alias("place"), "embedding"), least, "memory_type", earlier=True)
        return found.select(F.col("left_id").alias("__place"), F.col("right_id").alias("other"), "sim")

    while True:
        if confirm is None:
            # These merge, whatever else comes before them.
            left = left.where(F.coalesce(sure, F.lit(-2.0)) < hard)
        if left.isEmpty():
            break
        # The first round finds each row's most similar before it at all, as what is inserted of any round is among these rows.
        waits = saved(left.join(before(left, left, hard if confirm is None and found is not None else soft), "__place", "left"), "upload-waits")
        if confirm is None:
            ready = F.col("other").isNull() | (F.col("sim") < hard)
            goes = waits.where(ready)
        else:
            settled = (sure > F.col("sim")) | ((sure == F.col("sim")) & ((F.col("old_sim") == sure) | (F.col("new_place") < F.col("other"))))
            ready = F.col("other").isNull() | F.coalesce(settled, F.lit(False))
            goes = waits.where(ready).join(_merged(waits.where(ready), rows, old, confirm, hard), "__place", "left_anti")
        first = saved(goes.select("__place", "memory_type", "embedding"), "upload-new")
        inserted = first if inserted is None else inserted.unionByName(first)
        rest = waits.where(~ready)
        # Whose most similar row was inserted now need not look for it among those.
        seen = first.select(F.col("__place").alias("other"))
        known = rest.select("__place", "other", "sim").join(seen, "other", "left_semi")
        near = known.unionByName(before(rest.join(seen, "other", "left_anti"), first, hard if confirm is None else soft))
        rest = rest.drop("other", "sim")
        closer = F.col("sim").isNotNull() & (F.col("new_sim").isNull() | (F.col("sim") > F.col("new_sim")) | ((F.col("sim") == F.col("new_sim")) & (F.col("other") < F.col("new_place"))))
        moved = rest.join(near, "__place", "left").withColumn("c", closer)
        done, left = left, saved(moved.withColumns({"new_place": F.when(F.col("c"), F.col("other")).otherwise(F.col("new_place")), "new_sim": F.when(F.col("c"), F.col("sim")).otherwise(F.col("new_sim"))}).drop("other", "sim", "c"), "upload-open")
        discard(done)
        if found is None:
            found = waits
        else:
            discard(waits)
    # Each row's nearest among all that were there when its turn came.
    if inserted is None:
        inserted = vectors.limit(0)
    fresh = inserted.select("__place").withColumn("__new", F.lit(True))
    names = rows.select(F.col("__place").alias("other"), F.col("new_id").alias("earlier_id"))
    if found is None:
        nearest = before(vectors, inserted, soft)
    else:
        known = found.where("other IS NOT NULL").select("__place", "other", "sim").join(inserted.select(F.col("__place").alias("other")), "other", "left_semi")
        settled = known.select("__place").unionByName(found.where("other IS NULL").select("__place"))
        nearest = known.unionByName(before(vectors.join(settled, "__place", "left_anti"), inserted, soft))
    nearest = nearest.withColumnRenamed("sim", "new_sim").join(names, "other")
    out = rows.join(best_old, "__place", "left").join(nearest, "__place", "left").join(fresh, "__place", "left")
    of_old = F.coalesce(F.col("old_sim") >= F.col("new_sim"), F.col("old_sim").isNotNull())
    out = out.withColumns({"sim": F.greatest("old_sim", "new_sim"), "id": F.when(of_old, F.col("old_id")), "earlier_id": F.when(~of_old, F.col("earlier_id")), "action": F.when(F.col("__new"), "insert").otherwise("merge")})
    merge = F.col("action") == "merge"
    out = out.withColumns({"duplicate_of": F.when(merge, F.col("id")), "duplicate_of_new": F.when(merge, F.col("earlier_id"))}).drop("__place", "__new", "old_id", "old_sim", "new_sim", "other")
    # What is made of an upload reads it several times, and the last comparison is done once.
    return saved(out, "upload-result")


def _merged(ready: DataFrame, rows: DataFrame, old: DataFrame, confirm, hard: float) -> DataFrame:
    """Of rows whose nearest is known those that merge into it. Only texts that a confirmation reads go on to its joins."""
    of_old = F.coalesce(F.col("old_sim") >= F.col("new_sim"), F.col("old_sim").isNotNull())
    pair = ready.select("__place", F.when(of_old, F.col("old_id")).alias("id"), F.when(~of_old, F.col("new_place")).alias("other"), F.greatest("old_sim", "new_sim").alias("sim")).where("sim IS NOT NULL")
    # Saved, so that Spark knows how few they are where it finds their texts.
    pair = saved(pair, "upload-pairs")
    read = lambda d, key, name: d.join(pair.select(F.col(name).alias(key)), key, "left_semi")
    texts = rows.select("__place", "content", "context")
    first = read(old, "id", "id").select("id", F.col("content").alias("a"), F.col("context").alias("ax"))
    second = read(texts, "__place", "other").select(F.col("__place").alias("other"), F.col("content").alias("b"), F.col("context").alias("bx"))
    pair = pair.join(read(texts, "__place", "__place"), "__place").join(first, "id", "left").join(second, "other", "left")
    says = confirm(F.when(F.col("id").isNotNull(), F.col("a")).otherwise(F.col("b")), F.when(F.col("id").isNotNull(), F.col("ax")).otherwise(F.col("bx")), F.col("content"), F.col("context"))
    return pair.where((F.col("sim") >= hard) | F.coalesce(says, F.lit(False))).select("__place")


#: Texts of one memory that are merged in one step of complete_uploads().
FOLD = 500


def complete_uploads(memories: DataFrame, uploaded: DataFrame, at: str, merger=None, embedder=embed, cap: int = DEFAULTS.tag_cap) -> DataFrame:
    """memories after upload(): rows inserted, and those that took hits brought up to date.

    A row of action insert becomes a memory of its new_id: warm, active, one hit, with its tags and summaries. Each row of action
    merge gives its memory, existing or inserted, one hit at `at`, and its tags after those it has (the first spelling of
    each, `cap` at most). A merger (see merged_fields) makes the memory's texts of the old and the row's, one row after the
    other; where they change, embedding and summaries follow. Without one texts stay. new_id is their order.
    Memories need the columns id, memory_type, content, context, resolution, tags, hit_count, tier, status; last_hit_at, created_at,
    embedding and summaries are kept up where they are there.

    Hits are sums, tags the first `cap` by order, so a memory that takes a third of all rows costs a task no more than
    others; texts are merged FOLD rows of a memory at a step.
    """
    fields, cols = ["content", "context", "resolution"], memories.columns
    when = F.lit(at).cast("timestamp_ntz")
    up = uploaded if "tags" in uploaded.columns else uploaded.withColumn("tags", F.array().cast("array<string>"))
    l0, l1 = T.summaries(*map(F.col, fields), DEFAULTS.l0_tokens, DEFAULTS.l1_tokens)
    given = {"id": F.col("new_id"), "tier": F.lit("warm"), "hit_count": F.lit(1), "status": F.lit("active"), "created_at": when, "last_hit_at": when, "summary_l0": l0, "overview_l1": l1}
    kinds = {f.name: f.dataType for f in memories.schema}
    value = lambda c: given.get(c, F.col(c) if c in up.columns else F.lit(None))
    born = up.where("action = 'insert'").select(*[value(c).cast(kinds[c]).alias(c) for c in cols])
    # The memories stay where they are: each use below reads the columns that it needs, and most need no texts.
    now = memories.unionByName(saved(born, "upload-born"))
    hits = up.where("action = 'merge'").select(F.coalesce(F.col("duplicate_of"), F.col("duplicate_of_new")).cast(kinds["id"]).alias("id"), F.col("new_id").alias("seq"), *fields, "tags")
    hits = saved(hits, "upload-hits")
    count = hits.groupBy("id").agg(F.count(F.lit(1)).alias("__hits"))
    tags = folded_tags(now.select("id", F.lit(None).cast("long").alias("seq"), "tags").join(count.select("id"), "id", "left_semi").unionByName(hits.select("id", F.col("seq").cast("long"), "tags")), cap)
    out = now.join(count, "id", "left").join(tags.withColumnRenamed("tags", "__tags"), "id", "left")
    hit = F.col("__hits").isNotNull()
    values = {"hit_count": F.col("hit_count") + F.coalesce("__hits", F.lit(0)), "tags": F.when(hit, F.coalesce("__tags", F.array().cast("array<string>"))).otherwise(F.col("tags"))}
    if "last_hit_at" in cols:
        values["last_hit_at"] = F.when(hit, when).otherwise(F.col("last_hit_at"))
    out = out.withColumns(values)
    if merger is not None:
        texts = _folded_texts(now.select("id", *fields), hits, merger)
        out = out.join(texts, "id", "left")
        changed = F.col("__merged").isNotNull() & ~F.struct(*fields).eqNullSafe(F.col("__merged"))
        out = out.withColumn("__changed", changed).withColumns({c: F.when(F.col("__changed"), F.col(f"__merged.{c}")).otherwise(F.col(c)) for c in fields})
        fresh = {}
        if "embedding" in cols:
            fresh["embedding"] = F.when(F.col("__changed"), embedder(F.when(F.col("__changed"), T.embed_input(F.col("memory_type"), *map(F.col, fields))))).otherwise(F.col("embedding"))
        if "summary_l0" in cols:
            fresh |= {"summary_l0": F.when(F.col("__changed"), l0).otherwise(F.col("summary_l0")), "overview_l1": F.when(F.col("__changed"), l1).otherwise(F.col("overview_l1"))}
        out = out.withColumns(fresh) if fresh else out
    return out.select(*cols)


def folded_tags(rows: DataFrame, cap: int | None = DEFAULTS.tag_cap) -> DataFrame:
    """(id, tags) of rows(id, seq, tags): the tags of each id's rows by seq (null first), trimmed, the first spelling of each
    without regard to case, `cap` at most. By aggregates: no id's rows meet before its distinct tags are cut to the cap."""
    each = rows.select("id", "seq", F.posexplode("tags").alias("at", "t")).withColumn("t", T.strip(F.col("t"))).where("t <> ''")
    place = F.struct(F.coalesce(F.col("seq"), F.lit(-(1 << 63))).alias("s"), F.col("at"), F.col("t"))
    first = each.groupBy("id", T.folded(F.col("t")).alias("k")).agg(F.min(place).alias("p"))
    if cap is not None:
        first = first.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy("p"))).where(F.col("r") <= cap)
    return first.groupBy("id").agg(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["t"]).alias("tags"))


def _folded_texts(texts: DataFrame, hits: DataFrame, merger) -> DataFrame:
    """(id, __merged): the texts of memories that took hits after a merger has gone over these in order."""
    fields = ["content", "context", "resolution"]
    parts = lambda s: [s[c] for c in fields]
    numbered = saved(hits.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy("seq"))), "upload-numbered")
    sizes = numbered.groupBy("id").agg(F.max("r").alias("n"))
    now = texts.join(sizes, "id").select("id", "n", F.struct(*fields).alias("__merged"))
    done = now.select("id", "__merged").limit(0)
    last = numbered.agg(F.max("r")).first()[0] or 0
    for start in range(0, last, FOLD):
        some = numbered.where((F.col("r") > start) & (F.col("r") <= start + FOLD)).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("r", *fields))).alias("l"))
        step = lambda acc, x: F.struct(*[c.alias(n) for n, c in zip(fields, merged_fields(parts(acc), parts(x), merger), strict=True)])
        folded = saved(now.join(some, "id").select("id", "n", F.aggregate("l", F.col("__merged"), step).alias("__merged")), "upload-folded")
        # Only memories that have more to take go on to the next step.
        over = folded.where(F.col("n") <= start + FOLD).select("id", "__merged")
        done = over if start == 0 else done.unionByName(over)
        now = folded.where(F.col("n") > start + FOLD)
    return done


def contributions(uploaded: DataFrame, at: str) -> DataFrame:
    """(memory_id, content, context, resolution, contributed_at): a row for each merge that brings a content or a resolution."""
    m = uploaded.where("action = 'merge' AND (coalesce(content, '') <> '' OR coalesce(resolution, '') <> '')")
    return m.select(F.coalesce(F.col("duplicate_of"), F.col("duplicate_of_new")).alias("memory_id"), "content", "context", "resolution", F.lit(at).cast("timestamp_ntz").alias("contributed_at"))


def merge_tags(memories: DataFrame, incoming: DataFrame, cap: int = DEFAULTS.tag_cap) -> DataFrame:
    joined = memories.join(incoming, "id", "left")
    both = F.concat("tags", F.coalesce("incoming", F.array().cast("array<string>")))
    return joined.withColumn("tags", F.when(F.col("incoming").isNotNull(), T.fold_tags(both, cap)).otherwise(F.col("tags"))).drop("incoming")


def mergeable(pairs: DataFrame, hard: float = DEFAULTS.dedup_hard, dry_run: bool = False, confirm: Column | None = None) -> DataFrame:
    """The pairs that consolidation may merge: those at `hard`, and those below that `confirm` (a boolean column over
    pairs) holds for; without a confirmation all of them. A dry run takes only those at `hard`."""
    sure = F.col("sim") >= hard
    if dry_run:
        return pairs.where(sure)
    return pairs if confirm is None else pairs.where(sure | confirm)


def greedy_merges(pairs: DataFrame, most: int | None = None) -> DataFrame:
    """(winner, loser, sim): pairs in order of similarity, then winner, then loser, each taken unless one of its ends
    is the loser of a pair taken before; the first `most` of them.

    Rounds of local choice: a pair is taken for sure when no open pair before it has one of its ends as loser, and
    what ranks after a taken pair and has its loser at an end goes. Once `most` are taken, pairs that rank after these cannot matter and go
    as well. A round is one aggregate and a few joins over a saved table; there are as many as the longest chain of
    pairs that wait for each other.
    """
    key = F.struct((-F.col("sim")).alias("s"), F.col("winner").alias("w"), F.col("loser").alias("l"))
    left = saved(pairs.select("winner", "loser", "sim").withColumn("o", key), "merges-open")
    taken: DataFrame | None = None
    while not left.isEmpty():
        least = left.groupBy(F.col("loser").alias("n")).agg(F.min("o").alias("b"))
        own, other = least.select(F.col("n").alias("loser"), F.col("b").alias("bl")), least.select(F.col("n").alias("winner"), F.col("b").alias("bw"))
        first = left.join(own, "loser").join(other, "winner", "left").where("o = bl AND (bw IS NULL OR o < bw)")
        # A pair that is there twice is taken once; of one with several similarities the others go with their loser.
        now = first.select("winner", "loser", "sim", "o").distinct()
        before, taken = taken, saved(now if taken is None else taken.unionByName(now), "merges-taken")
        # A pair that ranks before a taken one is not hindered by it.
        gone = taken.select(F.col("loser").alias("n"), F.col("o").alias("since"))
        rest = left.join(gone, F.expr("loser = n AND o >= since"), "left_anti").join(gone, F.expr("winner = n AND o > since"), "left_anti")
        if most is not None:
            # The most-th of those taken so far: at most `most` rows, sorted by Spark's top-k.
            head = taken.orderBy("o").limit(most).agg(F.count(F.lit(1)).alias("k"), F.max("o").alias("last")).where(F.col("k") == most)
            rest = rest.join(F.broadcast(head), F.expr("o > last"), "left_anti")
        done, left = left, saved(rest, "merges-open")
        discard(done, *([before] if before is not None else []))
    discard(left)
    if taken is None:
        return pairs.select("winner", "loser", "sim").limit(0)
    ordered = taken.orderBy("o")
    return (ordered if most is None else ordered.limit(most)).drop("o")


def merged_fields(old: list[Column], new: list[Column], merger=None, cap: int = DEFAULTS.merge_field_tokens) -> list[Column]:
    """content, context and resolution of a merged pair: what a merger, a column function of both triples to a struct of
    the three or null, makes of them, each within the cap and the old field where it is empty. Without a merger, or
    where it gives null, the old fields."""
    if merger is None:
        return old
    made = merger(old, new)
    return [F.when(made.isNull(), o).otherwise(T.merged_or_old(made[n], o, cap)) for n, o in zip(("content", "context", "resolution"), old, strict=True)]


def rule_merger(old: list[Column], new: list[Column], cap: int = DEFAULTS.merge_field_tokens) -> Column:
    """A merger by rule, for want of a model."""
    return F.struct(*[T.merge_texts(o, n, cap).alias(c) for c, o, n in zip(("content", "context", "resolution"), old, new, strict=True)])


def apply_merges(memories: DataFrame, merges: DataFrame, merger=None, embedder=embed, at: str | None = None) -> DataFrame:
    """memories after merges(winner, loser, sim) in their order, each made of the rows as they were before all of them.

    A merge that leaves the winner's text as it is changes nothing. Else the winner has one more hit if the loser had
    any (last hit at `at`, where given), the merged fields with their embedding and summaries, and both rows' tags;
    the loser is archived. Of several merges into one winner the last one's fields and tags stay.
    """
    fields, cols = ["content", "context", "resolution"], memories.columns
    side = lambda name, own: merges.select("winner", "loser", "sim").join(memories.select(F.col("id").alias(name), *[F.col(c).alias(f"{own}_{c}") for c in [*fields, "tags", "hit_count"]]), name)
    both = side("winner", "w").join(side("loser", "l").drop("sim"), ["winner", "loser"])
    made = merged_fields([F.col(f"w_{c}") for c in fields], [F.col(f"l_{c}") for c in fields], merger)
    both = both.withColumns({f"m_{c}": m for c, m in zip(fields, made, strict=True)})
    same = F.lit(True)
    for c in fields:
        same = same & F.col(f"m_{c}").eqNullSafe(F.col(f"w_{c}"))
    tags = T.fold_tags(F.concat(F.coalesce("w_tags", F.array().cast("array<string>")), F.coalesce("l_tags", F.array().cast("array<string>"))), DEFAULTS.tag_cap)
    changed = both.where(~same).withColumns({"order": F.struct(-F.col("sim"), "winner", "loser"), "m_tags": tags})
    last = F.max_by(F.struct(*[F.col(f"m_{c}").alias(c) for c in [*fields, "tags"]]), "order")
    won = changed.groupBy(F.col("winner").alias("id")).agg(F.count_if(F.col("l_hit_count") > 0).alias("__hits"), last.alias("__new"))
    lost = changed.select(F.col("loser").alias("id")).distinct().withColumn("__lost", F.lit(True))
    out = memories.join(won, "id", "left").join(lost, "id", "left")
    new = F.col("__new").isNotNull()
    values = {c: F.when(new, F.col(f"__new.{c}")).otherwise(F.col(c)) for c in [*fields, "tags"]}
    values |= {"hit_count": F.col("hit_count") + F.coalesce("__hits", F.lit(0)), "status": F.when(F.col("__lost"), "archived").otherwise(F.col("status"))}
    own = [F.col(f"__new.{c}") for c in fields]
    if at is not None and "last_hit_at" in cols:
        values["last_hit_at"] = F.when(F.col("__hits") > 0, F.lit(at).cast("timestamp_ntz")).otherwise(F.col("last_hit_at"))
    if "embedding" in cols:
        values["embedding"] = F.when(new, embedder(F.when(new, T.embed_input(F.col("memory_type"), *own)))).otherwise(F.col("embedding"))
    if "summary_l0" in cols:
        l0, l1 = T.summaries(*own, DEFAULTS.l0_tokens, DEFAULTS.l1_tokens)
        values |= {"summary_l0": F.when(new, l0).otherwise(F.col("summary_l0")), "overview_l1": F.when(new, l1).otherwise(F.col("overview_l1"))}
    return out.withColumns(values).select(*cols)


def segment_sessions(messages: DataFrame, window: int) -> DataFrame:
    """(session, segment_index, start_line, end_line, fingerprint): one segment for each token window of a session.

    The default segmenter: at most two messages are one segment, else each window is one. A model that finds tasks
    takes its place as a grouped function of the same result.
    """
    w = M.windows(messages, ["session"], window).select("session", "msg_idx", "window")
    size = messages.groupBy("session").agg(F.count(F.lit(1)).alias("n"))
    cut = w.join(size, "session").withColumn("segment_index", F.when(F.col("n") <= 2, 0).otherwise(F.col("window")))
    spans = cut.groupBy("session", "segment_index").agg(F.min("msg_idx").alias("start_line"), F.max("msg_idx").alias("end_line"))
    own = messages.join(cut.select("session", "msg_idx", "segment_index"), ["session", "msg_idx"])
    return spans.join(M.fingerprint(own, ["session", "segment_index"]), ["session", "segment_index"])


def task_segments(messages: DataFrame, segmenter=None, budget: int = DEFAULTS.extract_window_tokens) -> DataFrame:
    """(session, segment_index, start_line, end_line, topic): the tasks that a segmenter finds in each session.

    The segmenter takes the numbered lines of a window, which fit `budget` characters (a single message that does not
    is cut), and gives a list of (start, end, topic) that covers the window from 1 to its end without gap or overlap,
    or None. The next window begins at the last task found, which it replaces, or after the window if that is one
    task. A session of at most two messages is one task. A session gives no rows where the segmenter fails, or is
    None and there are more messages. Sessions are files of bounded size, one is one group.
    """
    lines = messages.select("session", "msg_idx", "role", F.coalesce("body", F.lit("")).alias("body"))

    def found(said: list[str]) -> list[tuple[int, int, str]] | None:
        if len(said) <= 2:
            return [(1, len(said), "full conversation")]
        if segmenter is None:
            return None
        out: list[tuple[int, int, str]] = []
        at = 0
        while at < len(said):
            shown, used = [], -1
            for n, text in enumerate(said[at:], 1):
                line = f"[{n}] {text}"
                if shown and used + 1 + len(line) > budget:
                    break
                shown.append(line[:budget])
                used += 1 + len(line)
            tasks = segmenter(shown)
            ends = [0, *(e for _, e, _ in tasks or [])]
            if not tasks or ends[-1] != len(shown) or any(s != before + 1 or e < s for (s, e, _), before in zip(tasks, ends)):
                return None
            out += [(at + s, at + e, t) for s, e, t in tasks]
            if at + len(shown) >= len(said):
                return out
            if len(tasks) == 1:
                at += len(shown)
            else:
                at = out.pop()[0] - 1
        return out

    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        ordered = group.sort_by("msg_idx")
        said = [f"[{r}]: {b}" for r, b in zip(ordered.column("role").to_pylist(), ordered.column("body").to_pylist(), strict=True)]
        tasks = found(said) or []
        return pa.table(
            {
                "session": pa.array([key[0].as_py()] * len(tasks), group.schema.field("session").type),
                "segment_index": pa.array(range(len(tasks)), pa.int32()),
                "start_line": pa.array([s for s, _, _ in tasks], pa.int32()),
                "end_line": pa.array([e for _, e, _ in tasks], pa.int32()),
                "topic": pa.array([t for _, _, t in tasks], pa.string()),
            }
        )

    kind = messages.schema["session"].dataType.simpleString()
    return lines.groupBy("session").applyInArrow(run, f"session {kind}, segment_index int, start_line int, end_line int, topic string")


def new_and_superseded(known: DataFrame, found: DataFrame) -> DataFrame:
    """(what, session, segment_index): segments to insert, and known ones at the same place with another fingerprint."""
    key = ["session", "fingerprint"]
    new = found.join(known.select(*key), key, "left_anti").select(F.lit("insert").alias("what"), "session", "segment_index")
    both = known.alias("k").join(found.alias("f"), ["session", "segment_index"]).where("k.fingerprint <> f.fingerprint")
    return new.unionByName(both.select(F.lit("superseded").alias("what"), "session", "segment_index"))


def label(segments: DataFrame, scorer=None) -> DataFrame:
    """segments(id, text) with quality_metrics and labeled, by a pluggable scorer: a column function of the text to
    a score in [0, 1]. The default grows with the text's length and is a stand-in of our own."""
    score = scorer(F.col("text")) if scorer else F.least(F.lit(1.0), F.length("text") / 200)
    metrics = F.to_json(F.struct(F.struct(F.round(score, 4).alias("overall_score"), F.lit("other").alias("task_type")).alias("summary")))
    return segments.withColumns({"quality_metrics": metrics, "labeled": F.lit(True)})


def upgrade_gate(evolutions: DataFrame) -> DataFrame:
    """evolutions with `outcome`: the first of a cluster crystallises, a later one must beat the score before it."""
    old = F.lag("new_score").over(Window.partitionBy("cluster_id").orderBy("timestamp", "id"))
    return evolutions.withColumn("__old", old).withColumn("outcome", F.when(F.col("__old").isNull(), "crystallized").when(F.col("new_score") > F.col("__old"), "recrystallized").otherwise("revert")).drop("__old")


def sft_export(segments: DataFrame, messages: DataFrame, least: int = 2) -> DataFrame:
    """(id, messages): the training messages of each segment in order, for segments with at least `least` messages."""
    own = slices(segments, messages).select("id", "msg_idx", M.training_message().alias("m"))
    listed = own.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("msg_idx", "m"))).alias("m"))
    return listed.where(F.size("m") >= least).select("id", F.transform("m", lambda e: e["m"]).alias("messages"))


def unit_interval(x: Column) -> Column:
    """A score or threshold clamped to [0, 1]; null stays null."""
    return F.when(x.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), x.cast("double"))))


def text_budget(prompt: Column, most: int = 200_000, reserve: int = 8192, counter=T.token_count) -> Column:
    """Tokens that a prompt leaves for a text, at least 256."""
    return F.greatest(F.lit(most - reserve) - counter(prompt), F.lit(256))


def concatenated(parts: DataFrame, key: list[str]) -> DataFrame:
    """(key, content): the texts of parts(key, pos, text) in order, a line each."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "text")))
    return parts.groupBy(*key).agg(F.array_join(F.transform(ordered, lambda e: e["text"]), "\n").alias("content"))
