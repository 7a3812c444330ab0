"""Path predicates and classification as codegen-friendly string expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules

_NUL = "\0"
_LOWER = "lower({})"
_CATEGORY_OF = {name: category for category, names in rules.IMPORTANT_NAMES.items() for name in names}
_PRUNED_DIR = r"(?:^|/)(?:\.[^/]*|" + "|".join(re.escape(d) for d in rules.IGNORED_DIRECTORIES) + ")/"


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def _quoted(values) -> str:
    return ", ".join(f"'{value}'" for value in values)


def _among(value: Column | str, values, wrap: str = "{}") -> Column:
    """Membership in a fixed list; for a named column as one SQL text, which plans much faster."""
    if isinstance(value, str):
        return F.expr(f"{wrap.format(f'`{value}`')} IN ({_quoted(values)})")
    wrapped = F.lower(value) if wrap == _LOWER else value
    return wrapped.isin(*values)


def file_name(path: Column | str) -> Column:
    return F.substring_index(_col(path), "/", -1)


def directory(path: Column | str) -> Column:
    """Everything before the file name, with its trailing slash; '' at the root."""
    path = _col(path)
    return F.left(path, F.length(path) - F.length(file_name(path)))


def extension(path: Column | str) -> Column:
    """Lower-case suffix with its dot; '' for ``Dockerfile``, ``foo.`` and ``.bashrc``.

    Takes a name or a whole path. One small expression on purpose: filters inline it several times.
    """
    return F.lower(F.regexp_extract(_col(path), r"[^/](\.[^./]+)\z", 1))


def keep_dir(path: Column | str) -> Column:
    """No parent directory is hidden or on the ignore list, whatever its case."""
    return ~F.lower(directory(path)).rlike(_PRUNED_DIR)


def keep_name(name: Column | str) -> Column:
    return ~F.startswith(_col(name), F.lit("."))


def keep_ext(ext: Column | str) -> Column:
    return ~_among(ext, rules.IGNORED_EXTENSIONS)


def size_ok(size: Column | str) -> Column:
    return _col(size).between(rules.MIN_FILE_BYTES, rules.MAX_FILE_BYTES)


def is_code(ext: Column | str) -> Column:
    return _among(ext, rules.CODE_EXTENSIONS)


def is_known_text(ext: Column | str) -> Column:
    """Extensions that skip the binary sniff."""
    return _among(ext, sorted({*rules.TEXT_EXTENSIONS, *rules.CODE_EXTENSIONS}))


def is_important(name: Column | str) -> Column:
    return _among(name, _CATEGORY_OF, _LOWER)


def important_category(name: Column | str) -> Column:
    """Category of a well-known file name, null for any other name."""
    table = F.expr(f"map({_quoted(v for pair in _CATEGORY_OF.items() for v in pair)})")
    return F.try_element_at(table, F.lower(_col(name)))


def file_class(name: Column | str, ext: Column | str) -> Column:
    """important, source or other; important wins."""
    return (
        F.when(is_important(name), F.lit("important"))
        .when(is_code(ext), F.lit("source"))
        .otherwise(F.lit("other"))
    )


def walk_key(path: Column | str) -> Column:
    """One string whose byte order is the walk order.

    A directory's own files come before its sub-directories, names in byte order, depth first.
    NUL cannot occur in a path: it ends each directory name, and one more NUL opens the file name,
    so it sorts ahead of any sub-directory.
    """
    return F.concat(F.replace(directory(path), F.lit("/"), F.lit(_NUL)), F.lit(_NUL), file_name(path))


def path_parts(path: Column | str) -> dict[str, Column]:
    name = file_name(path)
    return {"name": name, "ext": extension(path), "parent": F.rtrim(directory(path), F.lit("/"))}
