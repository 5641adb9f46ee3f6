"""Options from profiles, configuration files and the command line."""

from __future__ import annotations

import argparse
import json
import os
import sys
from dataclasses import dataclass

from ..functions.core import Options

_KEEP = {"privacy": "orientation color_profile", "sharing": "orientation color_profile copyright", "archive": "orientation color_profile copyright"}
PROFILES = {name: {f: True for f in flags.split()} for name, flags in _KEEP.items()}
PROFILES["privacy"]["keep"] = ("Orientation", "ICC Profile")
PROFILES["sharing"]["keep"] = (*PROFILES["privacy"]["keep"], "Copyright")
PROFILES["archive"] |= {"keep": (*PROFILES["sharing"]["keep"], "Title", "Description"), "remove": ("GPS", "Software")}


def with_profile(given: dict, name: str | None) -> dict:
    """A profile's settings win over explicit ones; an unknown profile changes nothing."""
    return {**given, **PROFILES.get(name or "", {})}


@dataclass(frozen=True)
class Job:
    """A whole command: inputs, removal options and output policy."""

    inputs: tuple[str, ...]
    options: Options
    output_dir: str | None = None
    suffix: str = "-clean"
    in_place: bool = False
    recursive: bool = True
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    dry_run: bool = False
    skip_existing: bool = False
    backup_suffix: str | None = None
    verify: bool = False
    inspect: bool = False
    stego: bool = False
    watch: bool = False
    print_as: str = "table"
    report: str | None = None
    quiet: bool = False


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="metaglean", description="Lists and removes metadata of media files.")
    p.add_argument("inputs", nargs="*")
    for flag in ("preserve-orientation", "preserve-color-profile", "preserve-copyright", "preserve-title", "preserve-description", "in-place", "dry-run", "skip-existing", "verify", "inspect", "stego", "watch", "quiet"):
        p.add_argument(f"--{flag}", action="store_true")
    p.add_argument("--no-recursive", dest="recursive", action="store_false")
    for flag in ("remove", "keep", "include", "exclude"):
        p.add_argument(f"--{flag}", default="", type=str)
    p.add_argument("--gps-redact", choices=("exact", "city", "region", "country", "remove"))
    p.add_argument("--profile", choices=tuple(PROFILES))
    p.add_argument("--print", dest="print_as", choices=("table", "csv", "json"), default="table")
    for flag in ("output-dir", "suffix", "backup-suffix", "report", "pdf-password", "inject-copyright", "inject-artist", "inject-software", "inject-image-description", "inject-date-time"):
        p.add_argument(f"--{flag}")
    return p


def config_arguments(path: str) -> tuple[list[str], list[str]]:
    """Arguments of a JSON configuration file, and its unknown keys; keys in kebab or camel case."""
    known = {a.dest: a for a in _parser()._actions if a.option_strings}
    with open(path, encoding="utf-8") as f:
        given = json.load(f)
    out, unknown = [], []
    for key, v in given.items():
        dest = "".join("_" + c.lower() if c.isupper() else c for c in key).replace("-", "_")
        if dest not in known:
            unknown.append(key)
        elif known[dest].nargs == 0:
            if v:
                out.append(known[dest].option_strings[0])
        else:
            out += [known[dest].option_strings[0], ",".join(v) if isinstance(v, list) else str(v)]
    return out, unknown


def find_config(name: str = ".metagleanrc") -> str | None:
    return next((p for d in (os.getcwd(), os.path.expanduser("~")) if os.path.isfile(p := os.path.join(d, name))), None)


def parse(argv: list[str], config: str | None = None) -> Job:
    """Arguments of the file, then of the command line; invalid ones raise SystemExit 3."""
    p = _parser()
    before, unknown = config_arguments(config) if config else ([], [])
    for key in unknown:
        print(f"unknown setting: {key}", file=sys.stderr)
    try:
        a = p.parse_args([*before, *argv])
    except SystemExit as e:
        raise SystemExit(3 if e.code else 0) from None
    words = lambda s: tuple(x.strip() for x in s.split(",") if x.strip())
    flags = {f: getattr(a, f"preserve_{f}") for f in ("orientation", "color_profile", "copyright", "title", "description")}
    inject = {k: v for k in ("copyright", "artist", "software", "image_description", "date_time") if (v := getattr(a, f"inject_{k}"))}
    given = with_profile({**flags, "remove": words(a.remove), "keep": words(a.keep)}, a.profile)
    options = Options(**given, gps_redact=a.gps_redact, inject=inject, pdf_password=a.pdf_password)
    return Job(tuple(a.inputs), options, a.output_dir, a.suffix or "-clean", a.in_place, a.recursive, words(a.include), words(a.exclude), a.dry_run, a.skip_existing, a.backup_suffix, a.verify, a.inspect, a.stego, a.watch, a.print_as, a.report, a.quiet)
