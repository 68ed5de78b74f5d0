"""Input folders of sources on a machine, the state they are in, the matrix of what sources support, and pruning of an archive's folders."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .collectors import SOURCES
from .swap import Store

#: Folders beside those of sources that may be pruned, and what stands for an unset variable, by platform.
AUXILIARY = ("archive-index", "rewrite-staging", "rewrite-backup", "rewrite-backups", "exports")
DEFAULTS = {"XDG_CONFIG_HOME": ("all", "$HOME/.config"), "XDG_CACHE_HOME": ("all", "$HOME/.cache"), "XDG_STATE_HOME": ("all", "$HOME/.local/state"), "APPDATA": ("windows", "$USERPROFILE/AppData/Roaming"), "LOCALAPPDATA": ("windows", "$USERPROFILE/AppData/Local"), "HOME": ("all", "$USERPROFILE"), "USERPROFILE": ("windows", "$HOME")}


@dataclass(frozen=True)
class Root:
    """A declared folder, its path if it could be resolved, the variables it names, and why it could not."""

    declared: str
    path: str | None
    variables: tuple[str, ...] = ()
    miss_reason: str | None = None


def _value(name: str, platform: str, env: Mapping[str, str], asked: tuple[str, ...] = ()) -> str | None:
    if env.get(name):
        return env[name]
    on, other = DEFAULTS.get(name, (None, ""))
    if on not in ("all", platform) or name in asked:
        return None
    variable = re.match(r"\$(\w+)", other).group(1)
    found = _value(variable, platform, env, (*asked, name))
    return None if found is None else found + other[len(variable) + 1 :]


def resolve(declared: str, platform: str, env: Mapping[str, str]) -> Root:
    """A declared folder with `~`, $NAME, ${NAME} and %NAME% filled in; an unset variable without a default makes it unresolved."""
    text, names = re.sub(r"^~(?=/|$)", "$HOME", declared), []

    def fill(match: re.Match[str]) -> str:
        name = next(g for g in match.groups() if g)
        if not (declared.startswith("~") and name == "HOME" and match.start() == 0):
            names.append(name)
        found = _value(name, platform, env)
        if found is None:
            raise KeyError(name)
        return found

    try:
        path = re.sub(r"\$\{(\w+)\}|\$(\w+)|%(\w+)%", fill, text)
    except KeyError as error:
        return Root(declared, None, tuple(sorted({*names, error.args[0]})), f"variable {error.args[0]} is unset")
    return Root(declared, path, tuple(sorted(set(names))))


def resolve_all(declared: Mapping[str, str], platform: str, env: Mapping[str, str]) -> tuple[list[Root], list[str]]:
    """Folders declared for a platform or for `all`, in order, and the reasons for those that are missed, each once."""
    own = [resolve(d, platform, env) for d, on in declared.items() if on in ("all", platform)]
    if not own:
        return [], [f"no folder is declared for {platform}"]
    return own, list(dict.fromkeys(r.miss_reason for r in own if r.miss_reason))


def inspect(spark: SparkSession, root: Root) -> dict:
    """Kind (unresolved, missing, directory, file, other), whether it can be read, and why not."""
    if root.path is None:
        return {"declared": root.declared, "path": None, "kind": "unresolved", "readable": False, "miss_reason": root.miss_reason}
    store = Store(spark, root.path)
    if not store.exists(root.path):
        return {"declared": root.declared, "path": root.path, "kind": "missing", "readable": False, "miss_reason": "nothing is there"}
    status = store.fs.getFileStatus(store.path(root.path))
    kind = "directory" if status.isDirectory() else "file" if status.isFile() else "other"
    access = spark._jvm.org.apache.hadoop.fs.permission.FsAction
    try:
        store.fs.access(store.path(root.path), access.READ_EXECUTE if kind == "directory" else access.READ)
        readable = True
    except Exception:  # noqa: BLE001 - whatever the store says, it does not let us read
        readable = False
    return {"declared": root.declared, "path": root.path, "kind": kind, "readable": readable, "miss_reason": None if readable else "it cannot be read"}


def support_matrix(spark: SparkSession) -> DataFrame:
    """(source, execution_context, support_level, artifacts) of every source."""
    return spark.createDataFrame([(s.key, s.execution_context, s.support_level, list(s.artifacts)) for s in SOURCES.values()], "source string, execution_context string, support_level string, artifacts array<string>")


def auxiliary(names: tuple[str, ...] = (), defaults: bool = False) -> list[str]:
    """Folders to prune beside runs: the default ones and those that are named, which must be direct children of the archive and not its runs."""
    chosen = []
    for name in (*(AUXILIARY if defaults else ()), *(n.strip() for n in names)):
        if not name or "/" in name or name in (".", "..") or name == "runs":
            raise ValueError(f"{name!r} is no folder that may be pruned")
        if name not in chosen:
            chosen.append(name)
    return chosen


def prune(spark: SparkSession, root: str, plan: DataFrame, names: tuple[str, ...] = (), defaults: bool = False, execute: bool = False) -> list[dict]:
    """Delete the runs that a plan (run_id, pruned) gives up, and auxiliary folders; returns each with its files and bytes.  Without `execute` nothing is deleted."""
    store = Store(spark, root)
    folders = [("run", f"{root}/runs/{r.run_id}") for r in plan.where("pruned").select("run_id").orderBy("run_id").collect()] + [("auxiliary", f"{root}/{n}") for n in auxiliary(names, defaults)]
    report = []
    for kind, folder in folders:
        if store.exists(folder):
            total = store.fs.getContentSummary(store.path(folder))
            report.append({"kind": kind, "path": folder, "file_count": total.getFileCount(), "byte_count": total.getLength(), "deleted": execute})
            if execute:
                store.delete(folder)
    return report
