"""Calls of child processes whose text has no stated encoding, in Python sources."""

from __future__ import annotations

import ast
import io
import tokenize
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ALWAYS, ENCODABLE = {"getoutput", "getstatusoutput", "popen"}, {"run", "Popen", "check_output", "check_call", "call"}


def _called(tree: ast.AST) -> Iterator[tuple[ast.Call, str]]:
    """Each call of subprocess, or of os.popen, with the function's own name, through any alias."""
    alias: dict[str, str] = {}
    for node in ast.walk(tree):
        for a in getattr(node, "names", ()) if isinstance(node, ast.Import | ast.ImportFrom) else ():
            if isinstance(node, ast.Import) and a.name in ("subprocess", "os"):
                alias[a.asname or a.name] = f"{a.name}."
            elif isinstance(node, ast.ImportFrom) and node.module == "subprocess":
                alias[a.asname or a.name] = f"subprocess.{a.name}"
    for node in ast.walk(tree):
        if isinstance(node, ast.Call):
            match node.func:
                case ast.Attribute(value=ast.Name(id=module), attr=name) if alias.get(module, "").endswith("."):
                    full = alias[module] + name
                case ast.Name(id=name) if "." in alias.get(name, "") and not alias[name].endswith("."):
                    full = alias[name]
                case _:
                    continue
            if full.startswith("subprocess.") or full == "os.popen":
                yield node, full.rpartition(".")[2]


def violations(source: str) -> list[tuple[int, str, str]]:
    """(line, function, reason); a literal false value turns text mode off, any other value may turn it on."""
    found = []
    for call, name in _called(ast.parse(source)):
        given = {k.arg: k.value for k in call.keywords}
        off = lambda key: key not in given or (isinstance(given[key], ast.Constant) and not given[key].value)  # noqa: E731, B023
        blank = "encoding" not in given or (isinstance(given["encoding"], ast.Constant) and given["encoding"].value is None)
        if name in ALWAYS:
            found.append((call.lineno, name, "always in the locale's encoding"))
        elif name in ENCODABLE and blank and not (off("text") and off("universal_newlines")):
            found.append((call.lineno, name, "encoding=None states none" if "encoding" in given else "text mode without an encoding"))
    return found


def lint(files: DataFrame) -> DataFrame:
    """path, line, function, reason, error for files (path, content): a row a violation, or one with error for a file that can't be
    decoded (by its own declaration) or parsed."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows: list[tuple] = []
            for path, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    code = tokenize.detect_encoding(io.BytesIO(content).readline)[0]
                    rows += [(path, *x, None) for x in violations(content.decode(code))]
                except (SyntaxError, ValueError, LookupError, RecursionError) as e:
                    rows.append((path, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "line", "function", "reason", "error"]).astype({"line": "Int32"})

    return files.mapInPandas(run, "path string, line int, function string, reason string, error string")


def lint_counts(found: DataFrame) -> DataFrame:
    return found.where("error is null").groupBy("path").agg(F.count("*").alias("violations"))
