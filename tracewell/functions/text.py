"""Text expressions: keys, paths, identities and the folding of details that only vary."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Files that can run; programs that persistence wraps around a payload; autostart keys.
EXECUTABLE = r"(?i)\.(exe|dll|sys|scr|com|ps1|psm1|bat|cmd|vbs|vbe|js|jse|hta|lnk|msi|jar)$"
LAUNCHERS = r"(?i)\\(cmd|powershell|pwsh|rundll32|regsvr32|wscript|cscript|mshta|conhost|explorer)\.exe$"
LAUNCHED = r"(?i)([a-z]:\\[^\"<>|*?\r\n]*?\.(?:exe|dll|com|scr|bat|cmd|ps1|vbs|js|hta))(?=$|[\s\",])"
AUTOSTART = (
    r"Run", r"RunOnce", r"RunOnceEx", r"RunServices", r"RunServicesOnce", r"Policies\\Explorer\\Run", r"Winlogon\\(Userinit|Shell|Notify)", r"Environment\\UserInitMprLogonScript",
    r"Image File Execution Options\\[^\\]+\\Debugger", r"SilentProcessExit", r"AppInit_DLLs", r"Services\\[^\\]+\\(ImagePath|Parameters\\ServiceDll)", r"Shell Folders\\Startup",
    r"Command Processor\\AutoRun", r"Schedule\\TaskCache",
)
PERSISTENCE_KEY = r"(?i)\\(" + "|".join(AUTOSTART) + r")(\\|$)"
_ZERO_GUID = "00000000-0000-0000-0000-000000000000"
_GUID = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"


def present(c: Column) -> Column:
    """Null for the empty string."""
    return F.nullif(c, F.lit(""))


def norm_key(c: Column) -> Column:
    """Lower case without separators."""
    return F.regexp_replace(F.lower(c), "[ _.@-]", "")


def guid(c: Column) -> Column:
    """P5: Windows GUIDs without braces in upper case, other identifiers as they are; the zero GUID is absent."""
    s = present(F.regexp_replace(F.trim(c), r"^\{|\}$", ""))
    s = F.when(s.rlike(_GUID), F.upper(s)).otherwise(s)
    return F.nullif(s, F.lit(_ZERO_GUID))


def basename(c: Column) -> Column:
    """The last part of a path that isn't empty, or the path."""
    return F.coalesce(F.get(F.reverse(F.filter(F.split(c, r"[\\/]"), lambda x: x != "")), F.lit(0)), c)


def canonical_host(c: Column) -> Column:
    """The short name in lower case; addresses as they are; absent: ''."""
    s = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return F.when(s.rlike("^[0-9.]+$") | s.contains(":"), s).otherwise(F.split_part(s, F.lit("."), F.lit(1)))


def canonical_user(c: Column) -> Column:
    r"""Without DOMAIN\ and @domain, lower case; "-" is absent."""
    s = F.trim(c)
    return F.when((s != "") & (s != "-"), F.lower(F.substring_index(F.substring_index(s, "\\", -1), "@", 1)))


def sha256_from(c: Column) -> Column:
    """The SHA-256 of a list of hashes."""
    return present(F.lower(F.regexp_extract(c, r"(?:^|,)\s*SHA256=([0-9A-Fa-f]{64})", 1)))


def hash256(c: Column) -> Column:
    """A SHA-256 alone or from a list."""
    s = F.trim(c)
    return F.coalesce(sha256_from(s), F.when(s.rlike("^[0-9a-fA-F]{64}$"), F.lower(s)))


def task_command(c: Column) -> Column:
    """Command and arguments of a scheduled task's XML."""
    part = lambda tag: present(F.trim(F.regexp_extract(c, rf"(?i)<{tag}>([^<]*)</{tag}>", 1)))
    command = part("Command")
    return F.when(command.isNotNull(), F.concat_ws(" ", command, part("Arguments")))


def path_key(c: Column) -> Column:
    r"""One spelling for a file whatever the slashes, \\?\ prefix, volume or case."""
    s = F.regexp_replace(F.trim(c), r"^\\\\\?\\", "")
    s = F.lower(F.translate(s, "/", "\\"))
    s = F.regexp_replace(s, r"^\\device\\harddiskvolume\d+(?=\\)", "")
    return F.regexp_replace(s, r"^[a-z]:(?=\\)", "")


def launched_paths(c: Column) -> Column:
    """P20: path keys of the executables that a command names, launchers only if it names nothing else."""
    found = F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(LAUNCHED), 1), path_key))
    payloads = F.filter(found, lambda p: ~p.rlike(LAUNCHERS))
    return F.coalesce(F.when(F.size(payloads) > 0, payloads).otherwise(found), F.array().cast("array<string>"))


def executable(c: Column) -> Column:
    return c.rlike(EXECUTABLE)


def persistence_key(c: Column) -> Column:
    return c.rlike(PERSISTENCE_KEY)


def variable(c: Column) -> Column:
    """Numbers, and words with a digit of four letters or more, become #."""
    return F.regexp_replace(c, "(?<![A-Za-z0-9])(?:(?=[A-Za-z]*[0-9])[A-Za-z0-9]{4,}|[0-9]+)(?![A-Za-z0-9])", "#")


def same_detail(kind: Column, detail: Column) -> Column:
    """P25: what two details must share to be the same activity."""
    cut = F.instr(detail, " = ")
    registry = F.when(cut == 0, variable(detail)).otherwise(F.concat(variable(F.substring(detail, F.lit(1), cut - 1)), F.substr(detail, cut)))
    files = kind.isin("file_create", "file_delete", "file_time") & ~executable(detail)
    return F.when((kind == "process_start") | files, variable(detail)).when(kind == "registry_set", registry).otherwise(detail)


def clip(c: Column, n: int) -> Column:
    """At most n characters, then an ellipsis."""
    return F.when(F.char_length(c) > n, F.concat(F.substring(c, 1, n), F.lit("…"))).otherwise(c)
