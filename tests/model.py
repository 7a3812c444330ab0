"""Small sequential models that the Spark operators are compared with."""

import posixpath

from corpusbrief.functions import rules

CATEGORY = {name: c for c, names in rules.IMPORTANT_NAMES.items() for name in names}


def suffix(name):
    stem, dot, tail = name.rpartition(".")
    return ("." + tail).lower() if dot and stem and tail else ""


def walk_sorted(paths):
    """Depth first, a directory's files before its sub-directories, names in byte order."""
    here, below = [], {}
    for path in paths:
        head, slash, rest = path.partition("/")
        if slash:
            below.setdefault(head, []).append(rest)
        else:
            here.append(path)
    ordered = sorted(here, key=lambda p: p.encode())
    for head in sorted(below, key=lambda p: p.encode()):
        ordered += [head + "/" + rest for rest in walk_sorted(below[head])]
    return ordered


def gate(path, content):
    """First gate the file fails, or its decoded text."""
    folders, name = path.split("/")[:-1], posixpath.basename(path)
    if any(f.startswith(".") or f.lower() in rules.IGNORED_DIRECTORIES for f in folders):
        return "directory", None
    if name.startswith("."):
        return "name", None
    ext = suffix(name)
    if ext in rules.IGNORED_EXTENSIONS:
        return "extension", None
    if ext not in rules.TEXT_EXTENSIONS + rules.CODE_EXTENSIONS and b"\0" in content[:1024]:
        return "binary", None
    if len(content) > 1048576:
        return "too_large", None
    if len(content) < 10:
        return "too_small", None
    text = content.decode("utf-8", "ignore").replace("\r\n", "\n").replace("\r", "\n")
    return ("kept", text) if text else ("empty", None)


def bundle(files, cap, budget):
    """(text, total characters, truncated) of one repository, given {path: bytes}."""
    important, source = [], []
    for path in walk_sorted(files):
        verdict, text = gate(path, files[path])
        name = posixpath.basename(path)
        if verdict != "kept":
            continue
        if name.lower() in CATEGORY:
            important.append((path, text))
        elif suffix(name) in rules.CODE_EXTENSIONS and len(source) < cap:
            source.append((path, text))
    whole = "".join(f"--- File: {p} ---\n{t}\n\n" for p, t in important + source)
    cut = len(whole) > budget
    return (whole[:budget] + rules.TRUNCATION_MARK if cut else whole), len(whole), cut


def fold(events):
    """Apply events in order; {id: (status, summary_set, summary, error)}."""
    state = {}
    for _, ident, status, summary, error in sorted(events):
        if not ident or status not in rules.STATUSES:
            continue
        _, was_set, kept, _ = state.get(ident, (None, False, None, None))
        if status == "COMPLETED":
            was_set, kept = True, summary
        state[ident] = (status, was_set, kept, error if status == "FAILED" else None)
    return state
