"""One invented incident in several renderings: the same story as NDJSON, EDR NDJSON, CSV and key=value text."""

from __future__ import annotations

import json
from datetime import datetime, timedelta, timezone

ORIGIN = datetime(2026, 9, 21, 17, 21, 26, 904000, tzinfo=timezone.utc)
HOST, USER = "WS-01", "alice"
# name: (pid, parent, path)
PROCESSES = {
    "services": (800, None, r"C:\Windows\System32\services.exe"),
    "explorer": (1000, None, r"C:\Windows\explorer.exe"),
    "sihost": (3000, "services", r"C:\Windows\System32\sihost.exe"),
    "invoice": (2000, "explorer", r"C:\Users\alice\Downloads\invoice.exe"),
    "stage2": (2100, "invoice", r"C:\Users\alice\AppData\stage2.exe"),
    "taskhostw": (2900, "sihost", r"C:\Windows\System32\taskhostw.exe"),
    "cmd": (3100, "sihost", r"C:\Windows\System32\cmd.exe"),
    "whoami": (3110, "cmd", r"C:\Windows\System32\whoami.exe"),
    "rundll32": (5000, "explorer", r"C:\Windows\System32\rundll32.exe"),
    "upd": (4000, "explorer", r"C:\ProgramData\upd.exe"),
    "chrome": (6000, "explorer", r"C:\Program Files\Chrome\chrome.exe"),
    "lsass": (700, None, r"C:\Windows\System32\lsass.exe"),
    "invoice2": (2000, None, r"C:\Users\alice\Downloads\invoice.exe"),
    "notepad": (2000, "explorer", r"C:\Windows\System32\notepad.exe"),
}
RUN_KEY = r"HKU\S-1-5-21-1\Software\Microsoft\Windows\CurrentVersion\Run\Updater"
# (Sysmon code, seconds, process, more)
EVENTS = [
    (1, -3600, "explorer", {}), (1, -3590, "notepad", {}), (5, -3500, "notepad", {}), (1, -1800, "taskhostw", {}), (1, 0, "invoice", {}), (22, 2, "invoice", {"query": "evil.example"}),
    (3, 3, "invoice", {"ip": "203.0.113.9", "port": 443}), (11, 5, "invoice", {"file": PROCESSES["stage2"][2]}), (1, 10, "stage2", {}), (8, 12, "invoice", {"target": "sihost"}), (17, 15, "stage2", {"pipe": r"\msse-77"}),
    (1, 16, "rundll32", {}), (18, 17, "rundll32", {"pipe": r"\msse-77"}), (1, 20, "cmd", {}), (1, 21, "whoami", {}), (11, 28, "stage2", {"file": PROCESSES["upd"][2]}), (13, 30, "stage2", {"key": RUN_KEY, "value": PROCESSES["upd"][2]}),
    (10, 40, "stage2", {"target": "lsass", "access": "0x1410"}), (10, 41, "stage2", {"target": "explorer", "access": "0x1fffff"}), (1, 120, "chrome", {}), (1, 200, "invoice2", {"host": "WS-02"}), (5, 300, "stage2", {}),
    (1, 3600, "upd", {}), (3, 3605, "upd", {"ip": "203.0.113.9", "port": 443}),
]
MEMBERS = {"invoice.exe:2000", "stage2.exe:2100", "sihost.exe:3000", "cmd.exe:3100", "whoami.exe:3110", "upd.exe:4000", "203.0.113.9:", "evil.example:"}
REJECTED = {"explorer.exe:1000", "rundll32.exe:5000"}


def guid(name: str) -> str:
    return f"{{{list(PROCESSES).index(name) + 1:08x}-0000-4000-8000-00000000abcd}}"


def stamp(seconds: float, more_ms: int = 0) -> str:
    return (ORIGIN + timedelta(seconds=seconds, milliseconds=more_ms)).strftime("%Y-%m-%dT%H:%M:%S.%f")[:-3] + "Z"


def base(path: str) -> str:
    return path.rsplit("\\", 1)[-1]


def ndjson() -> list[dict]:
    """Nested records of two channels: each start and end has a twin without GUIDs a millisecond later."""
    out = []
    for code, at, name, more in EVENTS:
        pid, parent, path = PROCESSES[name]
        host = more.get("host", HOST)
        data, process = {}, {"pid": pid, "entity_id": guid(name), "executable": path, "name": base(path)}
        r = {"@timestamp": stamp(at), "host": {"name": host.lower(), "hostname": host}, "user": {"name": USER}, "event": {"code": str(code), "provider": "Microsoft-Windows-Sysmon"}, "winlog": {"channel": "Microsoft-Windows-Sysmon/Operational", "event_id": code, "computer_name": f"{host}.corp.example", "event_data": data}, "process": process}
        if code == 1:
            process["command_line"] = f'"{path}"'
            if parent:
                ppid, _, ppath = PROCESSES[parent]
                process["parent"] = {"pid": ppid, "entity_id": guid(parent), "executable": ppath, "name": base(ppath)}
        if "target" in more:
            tpid, _, tpath = PROCESSES[more["target"]]
            data |= {"TargetProcessGUID": guid(more["target"]), "TargetProcessId": tpid, "TargetImage": tpath}
            if "access" in more:
                data["GrantedAccess"] = more["access"]
        if "file" in more:
            r["file"] = {"path": more["file"], "name": base(more["file"])}
        if "pipe" in more:
            r["file"] = {"name": more["pipe"]}
        if "key" in more:
            r["registry"] = {"path": more["key"], "data": {"strings": [more["value"]]}}
        if "ip" in more:
            r["destination"] = {"ip": more["ip"], "port": more["port"]}
        if "query" in more:
            r["dns"] = {"question": {"name": more["query"]}}
        out.append(r)
        if code in (1, 5):
            twin = {"@timestamp": stamp(at, 1), "host": {"name": host.lower()}, "user": {"name": USER}, "event": {"code": "4688" if code == 1 else "4689"}, "winlog": {"channel": "Security", "event_id": 4688 if code == 1 else 4689, "event_data": {}}, "process": {"pid": pid, "executable": path, "name": base(path)}}
            if code == 1:
                twin["process"]["command_line"] = f'"{path}"'
                if parent:
                    twin["process"]["parent"] = {"pid": PROCESSES[parent][0], "executable": PROCESSES[parent][2], "name": base(PROCESSES[parent][2])}
            out.append(twin)
    return out


COLUMNS = ["_time", "host", "source", "EventCode", "User", "Image", "CommandLine", "ProcessId", "ProcessGuid", "ParentImage", "ParentProcessId", "ParentProcessGuid", "TargetImage", "TargetProcessId", "TargetProcessGuid", "GrantedAccess", "TargetFilename", "TargetObject", "Details", "PipeName", "DestinationIp", "DestinationPort", "QueryName"]


def rows() -> list[dict]:
    """Flat records with Sysmon's own names."""
    out = []
    for code, at, name, more in EVENTS:
        pid, parent, path = PROCESSES[name]
        r = {"_time": stamp(at), "host": f"{more.get('host', HOST)}.corp.example", "source": "XmlWinEventLog:Microsoft-Windows-Sysmon/Operational", "EventCode": str(code), "User": f"CORP\\{USER}", "Image": path, "ProcessId": str(pid), "ProcessGuid": guid(name).upper()}
        if code == 1:
            r["CommandLine"] = f'"{path}"'
            if parent:
                r |= {"ParentImage": PROCESSES[parent][2], "ParentProcessId": str(PROCESSES[parent][0]), "ParentProcessGuid": guid(parent).upper()}
        if "target" in more:
            r |= {"TargetImage": PROCESSES[more["target"]][2], "TargetProcessId": str(PROCESSES[more["target"]][0]), "TargetProcessGuid": guid(more["target"])}
        r |= {to: str(more[k]) for k, to in (("access", "GrantedAccess"), ("file", "TargetFilename"), ("key", "TargetObject"), ("value", "Details"), ("pipe", "PipeName"), ("ip", "DestinationIp"), ("port", "DestinationPort"), ("query", "QueryName")) if k in more}
        out.append(r)
    return out


def cell(value: str) -> str:
    return '"' + value.replace('"', '""') + '"' if any(c in value for c in ',"\n') else value


def as_ndjson(records: list[dict] | None = None) -> str:
    return "".join(json.dumps(r) + "\n" for r in records or ndjson())


def as_csv() -> str:
    return "\r\n".join([",".join(COLUMNS), *(",".join(cell(r.get(c, "")) for c in COLUMNS) for r in rows())]) + "\r\n"


def as_text() -> str:
    return "".join(f"{r['_time']} Channel=Microsoft-Windows-Sysmon/Operational " + " ".join(f'{k}="{v.replace(chr(34), chr(92) + chr(34))}"' for k, v in r.items() if k != "_time") + "\n" for r in rows())
