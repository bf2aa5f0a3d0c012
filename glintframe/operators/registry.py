"""Installed model packs: folders of versioned packs and an atomic ledger of the active ones.

Plain driver code; :meth:`Registry.table` and :func:`checks` give what there
is as DataFrames.  Every change holds an exclusive lock, works in a hidden
folder, and switches the ledger last, so that an interrupted change leaves
either the old state or the new one.
"""

from __future__ import annotations

import argparse
import fcntl
import json
import os
import shutil
import tarfile
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import __version__
from ..functions.hashing import component_name
from ..sources import manifest as M
from ..sources.binaries import Projection, TokenTable
from ..sources.files import external_files, safe_relative, scan_tree
from ..sources.index_file import IndexFileError, read_header, replace_file

LEDGER = "packs.json"
LEDGER_FORMAT = 1
LOCK = ".lock"
WORK = ".work-"
MAX_REVISIONS = 10_000


class PackError(Exception):
    """A failed operation: code, message and what may help."""

    def __init__(self, code: str, message: str, hint: str = ""):
        super().__init__(message)
        self.code, self.hint = code, hint

    def report(self) -> dict:
        return {"code": self.code, "message": str(self), "hint": self.hint}


@dataclass(frozen=True)
class Installed:
    component: str
    id: str
    version: str
    role: str
    healthy: bool
    issue: str | None
    bytes: int


def model_files(manifest: M.Manifest) -> list[str]:
    """All files that a manifest needs, relative to its folder; each must lie inside and exist."""
    t = manifest.text
    named = [manifest.image.model, t.model, t.tokenizer, *(x[k] for x, k in ((t.token_embeddings, "table"), (t.projection, "path")) if x)]
    for graph in (manifest.image.model, t.model):
        path = manifest.root / graph
        if safe_relative(graph) and path.is_file():
            named += [str(Path(graph).parent / side) for side in external_files(path.read_bytes())]
    root = manifest.root.resolve()
    for name in named:
        path = (manifest.root / name).resolve()
        if not safe_relative(name) or not path.is_relative_to(root) or not path.is_file():
            raise PackError("file_missing", f"{name} isn't a file of the pack")
    return sorted({str(Path(n)) for n in named})


def validate_pack(folder: str | Path, sessions: bool = True) -> tuple[M.Manifest, list[dict]]:
    """The manifest and the files of a pack that works; otherwise an error.

    With ``sessions`` both models are loaded, their declared inputs and
    outputs must exist, and the tokenizer must know the end token.
    """
    folder = Path(folder)
    try:
        m = M.load(folder / M.FILE_NAME)
    except (OSError, ValueError) as e:
        raise PackError("manifest_invalid", str(e)) from e
    model_files(m)
    try:
        if m.text.token_embeddings:
            TokenTable(folder / m.text.token_embeddings["table"], m.text.token_embeddings["rows"], m.text.token_embeddings["dimensions"])
        if m.text.projection:
            p = Projection(folder / m.text.projection["path"], m.text.projection["inputDimensions"], m.text.projection["outputDimensions"])
            if p.columns != m.dimensions:
                raise ValueError("the projection has another width than the pack")
        if sessions:
            _check_sessions(m)
        return m, scan_tree(folder)
    except (OSError, ValueError, KeyError) as e:
        raise PackError("pack_invalid", str(e)) from e


def _check_sessions(m: M.Manifest) -> None:
    from ..functions.encoders import session
    from ..functions.text import tokenizer

    t, i = m.text, m.image
    wanted = [
        (i.model, [i.input, *filter(None, (i.pixel_attention_mask, i.spatial_shapes))], i.output),
        (t.model, [t.input, *filter(None, (t.attention_mask,)), *([t.token_embeddings["input"]] if t.token_embeddings else [])], t.output),
    ]
    for path, inputs, output in wanted:
        try:
            s = session(str(m.root / path))
        except Exception as e:  # noqa: BLE001 the runtime has many kinds of errors
            raise ValueError(f"{path} can't be loaded: {e}") from e
        lost = set(inputs) - {x.name for x in s.get_inputs()} | {output} - {x.name for x in s.get_outputs()}
        if lost:
            raise ValueError(f"{path} lacks {sorted(lost)}")
    if not t.tokenizer.endswith(".model") and tokenizer(str(m.root / t.tokenizer)).id_to_token(t.eos_token) is None:
        raise ValueError("the tokenizer doesn't know the end token")


class Registry:
    """The packs below one folder."""

    def __init__(self, folder: str | Path, sessions: bool = True):
        self.folder, self.sessions = Path(folder), sessions
        self.folder.mkdir(parents=True, exist_ok=True)

    # the ledger

    def ledger(self) -> dict:
        """{format, writtenBy, packs: {id: {active, previous?}}}; without a file an empty one."""
        path = self.folder / LEDGER
        if path.is_symlink():
            raise PackError("state_invalid", "the ledger is a link")
        if not path.exists():
            return {"format": LEDGER_FORMAT, "writtenBy": __version__, "packs": {}}
        try:
            state = json.loads(path.read_text())
            self._check(state)
            return state
        except (ValueError, KeyError, TypeError, AttributeError) as e:
            raise PackError("state_invalid", f"the ledger can't be read: {e}", "repair backs it up and adopts healthy packs") from e

    @staticmethod
    def _check(state: dict) -> None:
        if state["format"] != LEDGER_FORMAT:
            raise ValueError("unknown format")
        seen = set()
        for name, track in state["packs"].items():
            for ref in filter(None, (track["active"], track.get("previous"))):
                if ref["id"] != name or not ref["version"] or ref["dimensions"] <= 0 or not safe_relative(ref["component"]) or "/" in ref["component"]:
                    raise ValueError(f"the entry of {name} is unsound")
                if ref["component"] in seen:
                    raise ValueError(f"{ref['component']} is there twice")
                seen.add(ref["component"])

    def _save(self, state: dict) -> None:
        state = {"format": LEDGER_FORMAT, "writtenBy": __version__, "packs": dict(sorted(state["packs"].items()))}
        self._check(state)
        replace_file(self.folder / LEDGER, (json.dumps(state, indent=2) + "\n").encode())

    @contextmanager
    def _locked(self) -> Iterator[Path]:
        """The lock, and a private folder for unfinished work; leftovers of broken changes are put right first."""
        with open(self.folder / LOCK, "w") as f:
            try:
                fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
            except OSError as e:
                raise PackError("busy", "another change is running") from e
            self._recover()
            work = Path(tempfile.mkdtemp(prefix=WORK, dir=self.folder))
            try:
                yield work
            finally:
                shutil.rmtree(work, ignore_errors=True)

    def _recover(self) -> None:
        for old in self.folder.glob(f"{WORK}*"):
            # a removal that didn't get as far as the ledger is undone
            for staged in old.glob("removed-*"):
                home = self.folder / staged.name.removeprefix("removed-")
                if not home.exists() and self._known(home.name):
                    os.rename(staged, home)
            shutil.rmtree(old, ignore_errors=True)
        for stale in self.folder.glob(f"{LEDGER}.*.tmp"):
            stale.unlink()

    def _known(self, component: str) -> bool:
        try:
            return any(ref["component"] == component for t in self.ledger()["packs"].values() for ref in filter(None, (t["active"], t.get("previous"))))
        except PackError:
            return True

    # what there is

    def installed(self) -> list[Installed]:
        """Packs on disk and in the ledger, by id, version and component; those that the ledger misses on disk are unhealthy."""
        state = self.ledger()
        refs = {r["component"]: (role, r) for t in state["packs"].values() for role, r in (("active", t["active"]), ("previous", t.get("previous"))) if r}
        out = []
        for folder in sorted(self.folder.iterdir()):
            if folder.name.startswith(".") or folder.is_symlink() or not (folder / M.FILE_NAME).is_file():
                continue
            role, ref = refs.pop(folder.name, ("inactive", None))
            out.append(self._examine(folder, role, ref))
        out += [Installed(c, r["id"], r["version"], role, False, "pack_missing", r["bytes"]) for c, (role, r) in refs.items()]
        return sorted(out, key=lambda p: (p.id, p.version, p.component))

    def _examine(self, folder: Path, role: str, ref: dict | None) -> Installed:
        try:
            m, files = validate_pack(folder, sessions=False)
        except PackError as e:
            return Installed(folder.name, ref["id"] if ref else "", ref["version"] if ref else "", role, False, e.code, 0)
        issue = None
        if ref and (m.id, m.version, m.dimensions) != (ref["id"], ref["version"], ref["dimensions"]):
            issue = "identity_changed"
        elif ref and ref.get("files") and ref["files"] != files:
            issue = "files_changed"
        return Installed(folder.name, m.id, m.version, role, issue is None, issue, sum(f["bytes"] for f in files))

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([tuple(vars(p).values()) for p in self.installed()], "component string, id string, version string, role string, healthy boolean, issue string, bytes long")

    def adoptable(self, spark: SparkSession) -> DataFrame:
        """The ids of which there is exactly one healthy pack."""
        return self.table(spark).filter("healthy").groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.first("component").alias("component")).filter("n = 1").select("id", "component")

    def resolve(self, pack_id: str | None = None) -> Path:
        """The folder of the active pack of an id, or of the only id."""
        packs = self.ledger()["packs"]
        if pack_id is None and len(packs) != 1:
            raise PackError("ambiguous" if packs else "no_pack", "there isn't just one pack", "name its id")
        pack_id = pack_id or next(iter(packs))
        if pack_id not in packs:
            raise PackError("unknown_pack", f"there is no pack {pack_id}")
        return self.folder / packs[pack_id]["active"]["component"]

    def doctor(self, pack_id: str, index: str | Path | None = None) -> dict:
        """Checks of app, model, runtime and index, and whether all is well."""
        issues, results, active = [], [], None
        try:
            active = self.ledger()["packs"].get(pack_id, {}).get("active")
        except PackError as e:
            issues.append(e.report())
        results.append(("app", bool(active) and active["format"] == M.FORMAT))
        pack = next((p for p in self.installed() if active and p.component == active["component"]), None) if not issues else None
        results.append(("model", bool(pack and pack.healthy)))
        try:
            results.append(("runtime", bool(pack) and bool(validate_pack(self.folder / pack.component, self.sessions))))
        except PackError as e:
            issues.append(e.report())
            results.append(("runtime", False))
        fits = index is None
        if index is not None and active:
            try:
                h = read_header(index)
                fits = h.model == f"{active['id']}@{active['version']}" and h.dimensions == active["dimensions"]
            except (OSError, EOFError, IndexFileError) as e:
                issues.append(PackError("index_invalid", str(e)).report())
        results.append(("index", fits))
        return {"ok": all(x for _, x in results) and not issues, "checks": [{"subject": s, "compatible": c} for s, c in results], "issues": issues}

    # changes

    def _import(self, source: Path, work: Path) -> Path:
        """A checked copy of a pack folder, or of an archive with one pack in it."""
        if source.is_file():
            target = work / "unpacked"
            with tarfile.open(source) as archive:
                archive.extractall(target, filter="data")
            found = [p.parent for p in target.rglob(M.FILE_NAME)]
            if len(found) != 1:
                raise PackError("archive_invalid", "the archive doesn't hold just one pack")
            source = found[0]
        _, files = validate_pack(source, self.sessions)
        copy = work / "copy"
        shutil.copytree(source, copy)
        if validate_pack(copy, sessions=False)[1] != files:
            raise PackError("copy_differs", "the copy differs from its source")
        for f in files:
            with open(copy / f["path"], "rb") as h:
                os.fsync(h.fileno())
        return copy

    def put(self, source: str | Path, operation: str = "install") -> Path:
        """Installs, updates (to another version) or replaces (the same version) a pack; the active one becomes the previous."""
        with self._locked() as work:
            state = self.ledger()
            copy = self._import(Path(source), work)
            m, files = validate_pack(copy, sessions=False)
            old = state["packs"].get(m.id, {}).get("active")
            rules = {"install": old is None, "update": old is not None and old["version"] != m.version, "replace": old is not None and old["version"] == m.version}
            if operation not in rules:
                raise PackError("usage", f"unknown operation {operation}")
            if not rules[operation]:
                raise PackError(f"{operation}_refused", f"{m.id} {m.version} can't be put by {operation}", "choose install, update or replace by what is active")
            base = component_name(m.id, m.version)
            for n in range(MAX_REVISIONS + 1):
                component = base if n == 0 else f"{base}-r{n}"
                if not (self.folder / component).exists():
                    break
            else:
                raise PackError("too_many_revisions", "there is no free name")
            os.rename(copy, self.folder / component)
            ref = {"component": component, "id": m.id, "version": m.version, "format": M.FORMAT, "dimensions": m.dimensions, "bytes": sum(f["bytes"] for f in files), "files": files, "installedBy": __version__}
            try:
                self._save(state | {"packs": state["packs"] | {m.id: {"active": ref} | ({"previous": old} if old else {})}})
            except BaseException:
                shutil.rmtree(self.folder / component, ignore_errors=True)
                raise
            return self.folder / component

    def rollback(self, pack_id: str) -> Path:
        """Swaps the active and the previous pack; both must be healthy."""
        with self._locked():
            state = self.ledger()
            track = state["packs"].get(pack_id, {})
            if not track.get("previous"):
                raise PackError("no_previous", f"{pack_id} has no previous version")
            health = {p.component: p.healthy for p in self.installed()}
            if not all(health.get(track[r]["component"]) for r in ("active", "previous")):
                raise PackError("unhealthy", "both versions must be healthy")
            self._save(state | {"packs": state["packs"] | {pack_id: {"active": track["previous"], "previous": track["active"]}}})
            return self.folder / track["previous"]["component"]

    def remove(self, pack_id: str, version: str | None = None, component: str | None = None, allow_active: bool = False) -> str:
        """Removes the one pack that fits; an active one only where that is allowed."""
        with self._locked() as work:
            fits = [p for p in self.installed() if p.id == pack_id and version in (None, p.version) and component in (None, p.component)]
            if len(fits) != 1:
                raise PackError("no_match" if not fits else "ambiguous", f"{len(fits)} packs fit")
            pack, state = fits[0], self.ledger()
            if pack.role == "active" and not allow_active:
                raise PackError("active", f"{pack.component} is active")
            home, staged = self.folder / pack.component, work / f"removed-{pack.component}"
            if home.exists():
                os.rename(home, staged)
            try:
                packs = dict(state["packs"])
                if pack.role == "active":
                    del packs[pack_id]
                elif pack.role == "previous":
                    packs[pack_id] = {"active": packs[pack_id]["active"]}
                if packs != state["packs"]:
                    self._save(state | {"packs": packs})
            except BaseException:
                if staged.exists():
                    os.rename(staged, home)
                raise
            return pack.component

    def repair(self) -> list[str]:
        """Backs up a ledger that can't be read and adopts packs: of each id without an active one, the only healthy pack."""
        with self._locked():
            path = self.folder / LEDGER
            try:
                state = self.ledger()
            except PackError:
                n = 1
                while (backup := path.with_name(f"{LEDGER}.bad-{n}")).exists():
                    n += 1
                os.rename(path, backup)
                state = self.ledger()
            by_id: dict[str, list[Installed]] = {}
            for p in self.installed():
                if p.healthy and p.id not in state["packs"]:
                    by_id.setdefault(p.id, []).append(p)
            adopted = []
            for name, packs in by_id.items():
                if len(packs) == 1:
                    m, files = validate_pack(self.folder / packs[0].component, sessions=False)
                    state["packs"][name] = {"active": {"component": packs[0].component, "id": name, "version": m.version, "format": M.FORMAT, "dimensions": m.dimensions, "bytes": packs[0].bytes, "files": files, "installedBy": __version__}}
                    adopted.append(name)
            self._save(state)
            return adopted


def remove_manifest(path: str | Path) -> list[str]:
    """Removes a manifest with the files that no other manifest of its folder needs: all of them, or none."""
    path = Path(path).resolve()
    own = set(model_files(M.load(path)))
    for other in path.parent.glob("*.json"):
        if other != path:
            try:
                own -= set(model_files(M.load(other)))
            except (ValueError, PackError):
                continue
    work = Path(tempfile.mkdtemp(prefix=WORK, dir=path.parent))
    moved: list[tuple[Path, Path]] = []
    try:
        for n, name in enumerate([*sorted(own), path.name]):
            os.rename(path.parent / name, work / str(n))
            moved.append((path.parent / name, work / str(n)))
    except OSError as e:
        for home, staged in reversed(moved):
            os.rename(staged, home)
        raise PackError("remove_failed", str(e)) from e
    finally:
        shutil.rmtree(work, ignore_errors=True)
    return [*sorted(own), path.name]


def main(arguments: list[str] | None = None) -> int:
    """``python -m glintframe.operators.registry FOLDER OPERATION ...``; a failure prints its report and ends with 1."""
    parser = argparse.ArgumentParser(prog="registry", allow_abbrev=False)
    parser.add_argument("folder")
    ops = parser.add_subparsers(dest="operation", required=True)
    for name in ("install", "update", "replace"):
        ops.add_parser(name, allow_abbrev=False).add_argument("source")
    for name in ("rollback", "doctor"):
        ops.add_parser(name, allow_abbrev=False).add_argument("id")
    gone = ops.add_parser("remove", allow_abbrev=False)
    gone.add_argument("id")
    gone.add_argument("--version")
    gone.add_argument("--component")
    gone.add_argument("--allow-active", action="store_true")
    for name in ("list", "repair"):
        ops.add_parser(name, allow_abbrev=False)
    a = parser.parse_args(arguments)
    r = Registry(a.folder)
    try:
        if a.operation in ("install", "update", "replace"):
            out: object = str(r.put(a.source, a.operation))
        elif a.operation == "rollback":
            out = str(r.rollback(a.id))
        elif a.operation == "doctor":
            out = r.doctor(a.id)
        elif a.operation == "remove":
            out = r.remove(a.id, a.version, a.component, a.allow_active)
        elif a.operation == "repair":
            out = r.repair()
        else:
            out = [vars(p) for p in r.installed()]
    except PackError as e:
        print(json.dumps(e.report()))
        return 1
    print(json.dumps(out))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
