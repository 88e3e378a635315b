"""Measures detection runs over repositories: a census of their files, a run of each with
a time limit in a process of its own, stage counts and seconds, memory, and results as CSV
and JSON.

    python -m graftline.perf repositories.toml --output-dir out [--clone] [--dry-run]

The TOML file has an optional table ``defaults`` (clone_base, timeout, ruleset, min_lines,
similarity) and one ``repos`` entry per repository: name, and if wanted url, ref, path,
clone_to, languages, ignore_dirs, extra_args, enabled and notes.
"""

from __future__ import annotations

import argparse
import csv
import json
import os
import re
import subprocess
import sys
import threading
import time
import tomllib
from dataclasses import asdict, dataclass, field, fields
from pathlib import Path

from graftline.sources.languages import BY_SUFFIX

#: Folders that no census enters, besides hidden ones.
SKIPPED = frozenset("node_modules vendor dist build target __pycache__ venv site-packages".split())
STAGES = ("parse", "extract", "shingle", "minhash", "lsh", "verify")
#: A stage as the command line's ``--progress`` prints it.
_STAGE = re.compile(r"^(\w+): (\d+) in ([\d.]+) s$", re.M)


@dataclass
class Defaults:
    clone_base: str = "~/graftline-repositories"
    timeout: float = 1800.0
    ruleset: str = "default"
    min_lines: int = 5
    similarity: int = 100
    interval: float = 15.0


@dataclass
class Repository:
    name: str
    url: str | None = None
    ref: str | None = None
    path: str | None = None
    clone_to: str | None = None
    languages: list[str] = field(default_factory=list)
    ignore_dirs: list[str] = field(default_factory=list)
    extra_args: list[str] = field(default_factory=list)
    enabled: bool = True
    notes: str = ""

    def root(self, defaults: Defaults) -> Path:
        if self.path or self.clone_to:
            return Path(self.path or self.clone_to).expanduser()
        return Path(defaults.clone_base).expanduser() / self.name


@dataclass
class Result:
    """One run; counts are -1 where a run did not get so far."""

    name: str
    root: str
    languages: list[str]
    src_files: int = 0
    src_lines: int = 0
    counts: dict[str, int] = field(default_factory=dict)
    seconds: dict[str, float] = field(default_factory=dict)
    results: int = -1
    elapsed_s: float = 0.0
    peak_rss_mb: float = 0.0
    rss_samples: list[float] = field(default_factory=list)
    timed_out: bool = False
    error: str = ""

    def row(self) -> dict[str, object]:
        flat = {k: v for k, v in asdict(self).items() if k not in ("counts", "seconds", "rss_samples")}
        flat["languages"] = "+".join(self.languages)
        flat |= {f"n_{s}": self.counts.get(s, -1) for s in STAGES} | {f"t_{s}_s": self.seconds.get(s, -1.0) for s in STAGES}
        return flat | {"n_rss_samples": len(self.rss_samples)}


def load(path: str | Path) -> tuple[Defaults, list[Repository]]:
    """Settings and repositories of a TOML file; unknown keys are passed over."""
    with open(path, "rb") as f:
        raw = tomllib.load(f)
    pick = lambda cls, d: cls(**{k: v for k, v in d.items() if k in {x.name for x in fields(cls)}})
    return pick(Defaults, raw.get("defaults", {})), [pick(Repository, r) for r in raw.get("repos", [])]


def census(root: Path, ignore_dirs: list[str]) -> tuple[int, int]:
    """Source files under a folder and their line feeds; hidden folders, common build
    folders and ``ignore_dirs`` are not entered, unreadable files count without lines."""
    skipped = SKIPPED | set(ignore_dirs)
    n = lines = 0
    for folder, below, names in os.walk(root):
        below[:] = [d for d in below if d not in skipped and not d.startswith(".")]
        for name in names:
            if os.path.splitext(name)[1].lower() in BY_SUFFIX:
                n += 1
                try:
                    lines += (Path(folder) / name).read_bytes().count(b"\n")
                except OSError:
                    continue
    return n, lines


def clone(repo: Repository, root: Path) -> None:
    """Fetch a repository at its ref; a folder that exists already stays as it is."""
    if root.exists():
        return
    if not repo.url:
        raise ValueError(f"{repo.name} has no url")
    root.parent.mkdir(parents=True, exist_ok=True)
    ref = ["--branch", repo.ref] if repo.ref else []
    subprocess.run(["git", "clone", "--quiet", "--depth", "1", *ref, repo.url, str(root)], check=True)


def stages(log: str) -> tuple[dict[str, int], dict[str, float]]:
    """Counts and seconds of the stages that a run's output names; the last one counts."""
    found = {m[1]: (int(m[2]), float(m[3])) for m in _STAGE.finditer(log) if m[1] in STAGES}
    return {k: n for k, (n, _) in found.items()}, {k: s for k, (_, s) in found.items()}


def sarif_results(path: Path) -> int:
    """Results in a SARIF file, or -1 if it cannot be read."""
    try:
        return sum(len(r.get("results", [])) for r in json.loads(path.read_text(encoding="utf-8")).get("runs", []))
    except (OSError, ValueError):
        return -1


def resident_mb(pid: int) -> float:
    """Memory of a process and all below it, from the process table."""
    parents: dict[int, list[int]] = {}
    pages: dict[int, int] = {}
    for entry in os.scandir("/proc"):
        if entry.name.isdigit():
            try:
                stat = Path(entry.path, "stat").read_text().rsplit(")", 1)[1].split()
                parents.setdefault(int(stat[1]), []).append(int(entry.name))
                pages[int(entry.name)] = int(stat[21])
            except (OSError, IndexError):
                continue
    todo, total = [pid], 0
    while todo:
        p = todo.pop()
        total += pages.get(p, 0)
        todo += parents.get(p, [])
    return total * os.sysconf("SC_PAGE_SIZE") / 1e6


def run(repo: Repository, defaults: Defaults, out: Path) -> Result:
    """Detect in one repository, in a process that is ended at the time limit. A run that
    ends badly, or whose SARIF does not hold as many results as it counted groups, has an error."""
    root = repo.root(defaults)
    result = Result(repo.name, str(root), repo.languages, *census(root, repo.ignore_dirs))
    out.mkdir(parents=True, exist_ok=True)
    sarif, log = out / f"{repo.name}.sarif", out / f"{repo.name}.log"
    command = [sys.executable, "-m", "graftline.cli", "--ruleset", defaults.ruleset, "detect", str(root), "--progress", "--format", "sarif", "--output", str(sarif)]
    command += ["--similarity", str(defaults.similarity), "--min-lines", str(defaults.min_lines)]
    command += ["--ignore", ",".join(f"{d}/,**/{d}/**" for d in repo.ignore_dirs)] if repo.ignore_dirs else []
    began = time.time()
    with open(log, "w", encoding="utf-8") as f:
        process = subprocess.Popen(command + repo.extra_args, stdout=f, stderr=subprocess.STDOUT)
        ended = threading.Event()

        def poll() -> None:
            while not ended.wait(0 if not result.rss_samples else defaults.interval):
                result.rss_samples.append(resident_mb(process.pid))

        watch = threading.Thread(target=poll, daemon=True)
        watch.start()
        try:
            code = process.wait(defaults.timeout)
            if code > 1:
                result.error = f"exit code {code}"
        except subprocess.TimeoutExpired:
            result.timed_out = True
            process.kill()
            process.wait()
        ended.set()
        watch.join()
    result.elapsed_s = round(time.time() - began, 3)
    result.peak_rss_mb = round(max(result.rss_samples, default=0.0), 1)
    result.counts, result.seconds = stages(log.read_text(encoding="utf-8"))
    result.results = sarif_results(sarif)
    if not result.error and not result.timed_out and result.counts.get("verify", -1) != result.results:
        result.error = f"{result.counts.get('verify', -1)} groups, but {result.results} results"
    return result


def write(results: list[Result], out: Path) -> None:
    rows = [r.row() for r in results]
    with open(out / "results.csv", "w", newline="", encoding="utf-8") as f:
        w = csv.DictWriter(f, fieldnames=list(rows[0]) if rows else ["name"])
        w.writeheader()
        w.writerows(rows)
    (out / "results.json").write_text(json.dumps([asdict(r) for r in results], indent=1), encoding="utf-8")


def main(argv: list[str] | None = None) -> int:
    """0, or 1 if a run failed or ran out of time."""
    p = argparse.ArgumentParser(prog="graftline.perf", description="Measure detection over repositories.")
    p.add_argument("config")
    p.add_argument("--output-dir", default="perf-results")
    p.add_argument("--repo", action="append", default=[], help="only this repository; may be repeated")
    p.add_argument("--clone", action="store_true")
    p.add_argument("--dry-run", action="store_true", help="count files only")
    p.add_argument("--timeout", type=float)
    args = p.parse_args(argv)
    defaults, repos = load(args.config)
    if args.timeout:
        defaults.timeout = args.timeout
    out, results = Path(args.output_dir), []
    for repo in repos:
        if (args.repo and repo.name not in args.repo) or not (repo.enabled or args.repo):
            continue
        root = repo.root(defaults)
        try:
            if args.clone:
                clone(repo, root)
            if args.dry_run or not root.is_dir():
                n = census(root, repo.ignore_dirs)
                result = Result(repo.name, str(root), repo.languages, *n, error="" if root.is_dir() else "no such folder")
            else:
                result = run(repo, defaults, out)
        except (OSError, ValueError, subprocess.CalledProcessError) as e:
            result = Result(repo.name, str(root), repo.languages, error=str(e))
        results.append(result)
        print(f"{result.name}\t{result.src_files} files\t{result.src_lines} lines\t{result.results} results\t{result.elapsed_s:.1f} s\t{'time limit' if result.timed_out else result.error or 'ok'}")
    out.mkdir(parents=True, exist_ok=True)
    write(results, out)
    return int(any(r.error or r.timed_out for r in results))


if __name__ == "__main__":
    raise SystemExit(main())
