"""Workspaces of agents: sync, shares and runs as functions from tables to tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import sections as S
from sparkloom.operators import writes as W
from sparkloom.scratch import saved
from sparkloom.sources.packages import snapshot_of

_KEY = ["user_id", "agent_id"]


@dataclass
class Workspaces:
    """agents(user_id, agent_id, display_name), profiles(user_id, agent_id, product, resources, revision) and
    shares(token, user_id, agent_id, visibility, snapshot, short_code)."""

    agents: DataFrame
    profiles: DataFrame
    shares: DataFrame


def sync_up(old: Workspaces, incoming: DataFrame) -> Workspaces:
    """The tables after incoming(user_id, agent_id, product, resources): unknown agents are registered, profiles put in
    with their revision raised, and the snapshots of agents that share renewed."""
    fresh = incoming.select(*_KEY, F.lit("").alias("display_name"))
    agents = W.insert_or_ignore(old.agents, fresh, _KEY)
    profiles = W.next_revision(old.profiles, incoming.select(*_KEY, "product", "resources"), _KEY, ["product", "resources"])
    shots = incoming.select(*_KEY, snapshot_of(F.col("product"), F.col("resources")).alias("snapshot"))
    return Workspaces(agents, profiles, W.update(old.shares, shots, _KEY, ["snapshot"]))


def create_shares(old: Workspaces, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(shares, results) after requests(user_id, agent_id, visibility, token, short_code), one an agent.

    An agent that shares already keeps its token and has its snapshot renewed; one without a profile fails. results
    has (user_id, agent_id, outcome): created, refreshed or no profile.
    """
    shots = old.profiles.select(*_KEY, snapshot_of(F.col("product"), F.col("resources")).alias("snapshot"))
    asked = requests.dropDuplicates(_KEY).join(shots, _KEY, "left")
    has = old.shares.select(*_KEY).distinct().withColumn("__has", F.lit(True))
    told = asked.join(has, _KEY, "left").withColumn("outcome", F.when(F.col("snapshot").isNull(), "no profile").when(F.col("__has"), "refreshed").otherwise("created")).drop("__has")
    renewed = W.update(old.shares, told.where("outcome = 'refreshed'"), _KEY, ["snapshot"])
    new = told.where("outcome = 'created'").select(*old.shares.columns)
    return renewed.unionByName(new), told.select(*_KEY, "outcome")


def started_runs(runs: DataFrame, new: DataFrame) -> DataFrame:
    """runs with training runs put at their end that have no id there yet, pending where no status is given."""
    rows = new.withColumn("status", F.coalesce(F.nullif("status", F.lit("")), F.lit("pending")))
    return W.insert_or_ignore(runs, rows, ["id"])


def wiped(tables: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], DataFrame]:
    """The tables without rows, and (name, rows_deleted)."""
    counts = [t.agg(F.count(F.lit(1)).alias("rows_deleted")).select(F.lit(n).alias("name"), "rows_deleted") for n, t in tables.items()]
    total = counts[0]
    for c in counts[1:]:
        total = total.unionByName(c)
    return {n: t.limit(0) for n, t in tables.items()}, total


# What the files of a workspace are, by agent product, and where a file goes in another product.
#: Files of the user that any product takes.
PORTABLE = {
    "nanobot": ["SOUL.md", "USER.md", "memory/MEMORY.md", "memory/HISTORY.md"],
    "openclaw": ["SOUL.md", "USER.md", "IDENTITY.md", "MEMORY.md"],
    "hermes": ["SOUL.md", "memories/USER.md"],
    None: ["SOUL.md", "USER.md"],
}
#: Instructions of a product. None stands for products that are not listed.
CONFIG = {
    "nanobot": ["AGENTS.md", "HEARTBEAT.md", "TOOLS.md"],
    "openclaw": ["AGENTS.md", "HEARTBEAT.md", "TOOLS.md", "BOOTSTRAP.md"],
    "hermes": [],
    None: ["AGENTS.md", "HEARTBEAT.md", "TOOLS.md"],
}
#: The file whose task lines are merged one by one.
HEARTBEAT = {"nanobot": "HEARTBEAT.md", "openclaw": "HEARTBEAT.md", "hermes": "", None: "HEARTBEAT.md"}
#: (source product, path): the path in each target product, None where it has no such file.
PATHS: dict[tuple[str, str], dict[str, str | None]] = {
    ("nanobot", "USER.md"): {"openclaw": "USER.md", "hermes": "memories/USER.md"},
    ("openclaw", "USER.md"): {"nanobot": "USER.md", "hermes": "memories/USER.md"},
    ("hermes", "memories/USER.md"): {"nanobot": "USER.md", "openclaw": "USER.md"},
    ("nanobot", "memory/MEMORY.md"): {"openclaw": "MEMORY.md", "hermes": None},
    ("openclaw", "MEMORY.md"): {"nanobot": "memory/MEMORY.md", "hermes": None},
    ("nanobot", "SOUL.md"): {"openclaw": "SOUL.md", "hermes": "SOUL.md"},
    ("openclaw", "SOUL.md"): {"nanobot": "SOUL.md", "hermes": "SOUL.md"},
    ("hermes", "SOUL.md"): {"nanobot": "SOUL.md", "openclaw": "SOUL.md"},
    ("nanobot", "memory/HISTORY.md"): {"openclaw": None, "hermes": None},
    ("openclaw", "IDENTITY.md"): {"nanobot": None, "hermes": None},
    ("openclaw", "BOOTSTRAP.md"): {"nanobot": None, "hermes": None},
    ("nanobot", "AGENTS.md"): {"openclaw": "AGENTS.md", "hermes": None},
    ("nanobot", "HEARTBEAT.md"): {"openclaw": "HEARTBEAT.md", "hermes": None},
    ("nanobot", "TOOLS.md"): {"openclaw": "TOOLS.md", "hermes": None},
    ("openclaw", "AGENTS.md"): {"nanobot": "AGENTS.md", "hermes": None},
    ("openclaw", "HEARTBEAT.md"): {"nanobot": "HEARTBEAT.md", "hermes": None},
    ("openclaw", "TOOLS.md"): {"nanobot": "TOOLS.md", "hermes": None},
}
# End of fixed values.


@dataclass(frozen=True)
class Rules:
    """File classes by product (None: products that are not listed), the file of tasks, and the paths in other products."""

    portable: dict = field(default_factory=lambda: PORTABLE)
    config: dict = field(default_factory=lambda: CONFIG)
    heartbeat: dict = field(default_factory=lambda: HEARTBEAT)
    paths: dict = field(default_factory=lambda: PATHS)

    def listed(self, classes: dict, product, path):
        """Whether the product's class has the path, as a boolean column."""
        out = path.isin(classes[None])
        for name, files in classes.items():
            if name is not None:
                out = F.when(product == name, path.isin(files)).otherwise(out)
        return F.coalesce(out, F.lit(False))

    def is_heartbeat(self, product, path):
        out = path == self.heartbeat[None]
        for name, file in self.heartbeat.items():
            if name is not None:
                out = F.when(product == name, path == file).otherwise(out)
        return out


#: Templates of all products together that are broadcast; more are joined by sorting.
TEMPLATES = 4096


@dataclass
class Merged:
    """files(workspace, path, content) and log(workspace, step, pos, path, action, detail) of merged workspaces."""

    files: DataFrame
    log: DataFrame


def merge_workspaces(incoming: DataFrame, workspaces: DataFrame, defaults: DataFrame, skills: DataFrame, rules: Rules | None = None) -> Merged:
    """Incoming files put into workspaces of another product, or the same.

    incoming(workspace, pos, path, text) are a snapshot's files in order, workspaces(workspace, source, target) the products, defaults(product,
    pos, path, text) each product's templates, skills(workspace, name) those that a workspace has. Every file is one row of joins on its workspace and
    path, its action a conditional expression:
    files of a skill are imported, or skipped where the skill is there; a file without a place in the target is imported as it is; within one product
    all files are imported. In another product, a user's file is merged by sections where it has the same path and a template there; under another path what
    the user added is put behind the template; instructions are merged by sections, tasks line by line; all else is imported. Templates of the target
    fill what is missing. Of several files that come to one path the last counts. log tells each step, 1 for files and 2 for templates.
    """
    rules = rules or Rules()
    source, target, path, text = (F.col(c) for c in ("source", "target", "path", "text"))
    # Sizes that Spark estimates from files say nothing of the rows that are made of them, so joins by workspace sort and merge, and templates are counted.
    sort = lambda d: d.hint("merge")
    few = defaults.limit(TEMPLATES + 1).count() <= TEMPLATES
    by_product = F.broadcast if few else sort
    rows = incoming.select("workspace", "pos", "path", F.coalesce(text, F.lit("")).alias("text")).join(sort(workspaces.select("workspace", "source", "target")), "workspace")
    skill = path.startswith("skills/")
    name = F.coalesce(F.get(F.split(path, "/"), F.lit(1)), F.lit(""))
    has = skills.select("workspace", F.col("name").alias("__skill")).distinct().withColumn("__has", F.lit(True))
    rows = rows.withColumns({"__skill": F.when(skill, name), "to": F.when(~skill, S.target_path(source, path, target, rules.paths))}).join(sort(has), ["workspace", "__skill"], "left")
    own = defaults.select(F.col("product").alias("source"), "path", F.col("text").alias("__source"))
    theirs = defaults.select(F.col("product").alias("target"), F.col("path").alias("to"), F.col("text").alias("__target"))
    rows = rows.join(by_product(own), ["source", "path"], "left").join(by_product(theirs), ["target", "to"], "left").withColumns({c: F.coalesce(c, F.lit("")) for c in ("__source", "__target")})

    same, to, from_default, to_default = source == target, F.col("to"), F.col("__source"), F.col("__target")
    portable = rules.listed(rules.portable, source, path)
    either = portable | rules.listed(rules.portable, target, path)
    config = rules.listed(rules.config, source, path) | rules.listed(rules.config, target, path)
    memory = path.startswith("memory/") | path.startswith("memories/")
    tasks = rules.is_heartbeat(target, to)
    given = to_default != ""
    # Each case once: (condition, action, content, detail); the first that holds counts.
    said = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    summary = said("target default + ", S.changes(text, from_default).cast("string"), " user customization(s)")
    diff = S.user_lines(text, from_default)
    added = F.concat(F.regexp_replace(to_default, r"\s+\z", ""), F.lit("\n\n## Imported from "), source, F.lit(" "), path, F.lit("\n\n"), diff, F.lit("\n"))
    cases = [
        (skill & F.coalesce("__has", F.lit(False)), "skip", F.lit(None), said("Skill '", name, "' already exists on target, skipped")),
        (skill, "import", text, F.lit("Skill imported")),
        (to.isNull(), "import", text, said("No mapping for ", target, ", imported as-is")),
        (same & either, "import", text, F.lit("User data imported directly")),
        (same & config, "import", text, F.lit("Same product, imported directly")),
        (same & memory, "import", text, F.lit("Memory file imported directly")),
        (same, "import", text, F.lit("Imported directly")),
        (portable & given & (to == path), "merged", S.merged(text, from_default, to_default), summary),
        (portable & given & (diff != ""), "merged", added, said("Target template + user data from ", path)),
        (portable & given, "default", to_default, said("No user changes detected, using ", target, " default")),
        (portable, "import", text, said("Imported from ", path, F.when(to != path, F.concat(F.lit(" → "), to)).otherwise(""))),
        (config & ~given, "import", text, F.lit("No target default available, imported as-is")),
        (config & tasks, "merged", S.merged_tasks(text, from_default, to_default), summary),
        (config, "merged", S.merged(text, from_default, to_default), summary),
        (memory, "import", text, F.lit("Memory file imported directly")),
        (F.lit(True), "import", text, F.lit("Imported directly")),
    ]

    def chosen(value):
        out = F.lit(None)
        for n, case in reversed(list(enumerate(cases))):
            out = F.when(F.col("__case") == n, value(case)).otherwise(out)
        return out

    number = F.lit(len(cases) - 1)
    for n, case in reversed(list(enumerate(cases[:-1]))):
        number = F.when(case[0], n).otherwise(number)
    # Texts are compared after this exchange: tables of keys are small files, which few tasks read.
    rows = rows.repartition(int(incoming.sparkSession.conf.get("spark.sql.shuffle.partitions")), "workspace", "pos")
    rows = rows.withColumn("__case", number)
    rows = rows.select("workspace", "pos", F.coalesce(to, path).alias("path"), to.isNotNull().alias("handled"), chosen(lambda c: F.lit(c[1])).alias("action"), chosen(lambda c: c[2]).cast("string").alias("content"), chosen(lambda c: c[3]).alias("detail"))
    rows = saved(rows, "workspace-rows")

    files = rows.where("action <> 'skip'").groupBy("workspace", "path").agg(F.max_by("content", "pos").alias("content"))
    taken = rows.where("handled OR action <> 'skip'").select("workspace", "path").distinct()
    template = workspaces.select("workspace", F.col("target").alias("product")).join(by_product(defaults.select("product", "pos", "path", F.col("text").alias("content"))), "product")
    missing = template.join(sort(taken), ["workspace", "path"], "left_anti")
    log = rows.select("workspace", F.lit(1).alias("step"), "pos", "path", "action", "detail")
    filled = missing.select("workspace", F.lit(2).alias("step"), "pos", "path", F.lit("default").alias("action"), F.concat(F.lit("Added from "), "product", F.lit(" default template")).alias("detail"))
    return Merged(files.unionByName(missing.select("workspace", "path", "content")), log.unionByName(filled))
