"""Repository URL parsing, redaction and clone-failure messages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules
from .paths import _col
from .text import strip

# scheme (optional), authority with user info and port, path up to query or fragment
_WEB = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?//([^/?#]*)([^?#]*)"
_HTTP = r"(?i)^(https?)://([^/?#\\]*)(.*)$"
_MAX_URL_CHARS = 2083
_BLANKS = r"^[\s\x00]+|[\s\x00]+$"
_HOST_PORT = r"^(?:[^:\[\]\s<>^|%]+|\[[0-9A-Fa-f:.]+\])(?::([0-9]{0,5}))?$"
_LAST_PORT = 65535


def _cleaned(url: Column) -> Column:
    """URL parsing ignores leading control characters and any tab or line break."""
    return F.regexp_replace(F.regexp_replace(url, r"^[\x00-\x20]+", ""), r"[\t\r\n]", "")


def parse_repo_url(url: Column | str) -> Column:
    """struct<owner, repo, error>; owner and repo are null when error is set."""
    url = _col(url)
    none = F.lit(None).cast("string")

    ssh_path = F.regexp_replace(url, r"(?s)^[^:]*:", "")
    clean = _cleaned(url)
    scheme = F.lower(F.regexp_extract(clean, _WEB, 1))
    host = F.regexp_extract(clean, _WEB, 2)
    raw_path = F.regexp_extract(clean, _WEB, 3)
    # a ;parameter of the last path part is not part of the path in http and scheme-less URLs
    web_path = F.btrim(
        F.when(scheme.isin("", "http", "https"), F.regexp_replace(raw_path, r";[^/]*$", ""))
        .otherwise(raw_path),
        F.lit("/"),
    )

    is_ssh = F.startswith(url, F.lit("git@"))
    parts = F.split(F.when(is_ssh, ssh_path).otherwise(web_path), "/")
    owner = F.get(parts, F.lit(0))
    repo = F.replace(F.get(parts, F.lit(1)), F.lit(".git"), F.lit(""))
    unnamed = (owner == "") | (repo == "")

    ssh_error = (
        F.when(F.size(parts) < 2, F.concat(F.lit("Invalid SSH URL format: "), url))
        .when(unnamed, F.concat(F.lit("Invalid owner or repo name in SSH URL: "), url))
        .otherwise(none)
    )
    web_error = (
        F.when(
            F.contains(host, F.lit("[")) != F.contains(host, F.lit("]")),
            F.concat(F.lit("Could not parse GitHub URL '"), url, F.lit("': Invalid IPv6 URL")),
        )
        .when(
            ~F.contains(F.lower(host), F.lit("github.com")),
            F.concat(F.lit("URL does not appear to be a GitHub URL: "), url),
        )
        .when(F.size(parts) < 2, F.concat(F.lit("GitHub URL path must include owner/repo: "), url))
        .when(unnamed, F.concat(F.lit("Invalid owner or repo name in URL path: "), url))
        .otherwise(none)
    )
    error = (
        F.when(url.isNull() | (url == ""), F.lit("URL must be a non-empty string"))
        .when(is_ssh, ssh_error)
        .otherwise(web_error)
    )
    return F.struct(
        F.when(error.isNull(), owner).alias("owner"),
        F.when(error.isNull(), repo).alias("repo"),
        error.alias("error"),
    )


def canonical_url(owner: Column | str, repo: Column | str) -> Column:
    return F.concat(F.lit("https://github.com/"), _col(owner), F.lit("/"), _col(repo), F.lit(".git"))


def redact_url(url: Column | str) -> Column:
    return F.regexp_replace(_col(url), r"://[^/@]+@", "://[REDACTED_TOKEN]@")


def is_http_url(url: Column | str) -> Column:
    """An http or https URL with a host, of at most 2,083 characters; blanks around it don't count.

    A port must be a number up to 65,535. Hosts that are not ASCII and blanks in the path are taken
    as they are.
    """
    url = F.regexp_replace(_col(url), _BLANKS, "")
    place = F.regexp_replace(F.regexp_extract(url, _HTTP, 2), r"^.*@", "")
    port = F.coalesce(F.nullif(F.regexp_extract(place, _HOST_PORT, 1), F.lit("")), F.lit("0")).cast("int")
    return F.coalesce(place.rlike(_HOST_PORT) & (port <= _LAST_PORT) & (F.length(url) <= _MAX_URL_CHARS), F.lit(False))


def normal_http_url(url: Column | str) -> Column:
    """Lower-case scheme and host, no default port, '/' for an empty path, no blanks around."""
    url = F.regexp_replace(_col(url), _BLANKS, "")
    scheme = F.lower(F.regexp_extract(url, _HTTP, 1))
    authority = F.regexp_extract(url, _HTTP, 2)
    host = F.lower(F.regexp_replace(authority, r"^.*@", ""))
    user = F.left(authority, F.length(authority) - F.length(host))
    default_port = F.when(scheme == "https", F.lit(":443")).otherwise(F.lit(":80"))
    host = F.when(F.endswith(host, default_port), F.left(host, F.length(host) - F.length(default_port))).otherwise(host)
    rest = F.regexp_extract(url, _HTTP, 3)
    rest = F.when(F.startswith(rest, F.lit("/")), rest).otherwise(F.concat(F.lit("/"), rest))
    return F.concat(scheme, F.lit("://"), user, host, rest)


def clone_error(stderr: Column | str, has_token: Column | str, url: Column | str, exit_code: Column | str) -> Column:
    """What a failed clone is reported as, judged from git's standard error."""
    stderr, has_token = _col(stderr), _col(has_token)
    said = F.when(F.coalesce(stderr, F.lit("")) == "", F.lit("No stderr output.")).otherwise(strip(stderr))
    denied = F.contains(said, F.lit("Authentication failed")) | (
        ~has_token & F.contains(said, F.lit("could not read Username"))
    )
    reason = (
        F.when(
            denied,
            F.concat(
                F.lit(" Authentication failed."),
                F.when(has_token, F.lit("")).otherwise(F.lit(" This may be a private repository.")),
            ),
        )
        .when(F.contains(said, F.lit("Repository not found")), F.lit(" Repository not found or access denied."))
        .when(said != "", F.concat(F.lit(" Git error: "), F.left(said, F.lit(rules.CLONE_DETAIL_CHARS))))
        .otherwise(F.lit(""))
    )
    return F.concat(
        F.lit("Failed to clone repository '"), redact_url(url), F.lit("'. Git command failed (exit "),
        _col(exit_code).cast("string"), F.lit(")."), reason,
    )
