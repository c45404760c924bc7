"""SQL that reads the texts themselves: log lines, memory maps, scripts and container JSON are taken apart by DuckDB.

The lines are built from the derived tables as the queries build them; what they mean is then read from the line alone.
"""

from __future__ import annotations

from tracewright.functions import tables as T
from tracewright.plans.derived import duck

AUTH_LINES = f"""
SELECT concat(strftime(t, '%b '), lpad(CAST(day(t) AS VARCHAR), 2, ' '), strftime(t, ' %H:%M:%S '), h,
  CASE kind WHEN 0 THEN concat(' sshd[12]: Failed password for invalid user ', u, ' from ', ip, ' port 22 ssh2') WHEN 1 THEN concat(' sshd[7]: Accepted publickey for ', u, ' from ', ip)
    WHEN 2 THEN concat(' sudo: ', u, ' : TTY=pts/0 ; USER=root ; COMMAND=/bin/run ', k) ELSE ' kernel: up' END) line
FROM ({duck("auth_lines")})"""

#: at, host, category, severity, actor, target, action, port, command of all lines that say something.
AUTH = rf"""
SELECT CAST(epoch(strptime(concat('2024 ', regexp_replace(substr(line, 1, 15), '\s+', ' ', 'g')), '%Y %b %-d %H:%M:%S')) AS BIGINT) AS at, regexp_extract(substr(line, 17), '^\S+') host,
  CASE WHEN ssh.how <> '' THEN 'authentication' ELSE 'privilege_escalation' END category, CASE WHEN ssh.how = 'Accepted' THEN 'low' ELSE 'medium' END severity,
  CASE WHEN ssh.how <> '' THEN ssh.ip ELSE sudo.who END actor, CASE WHEN ssh.how <> '' THEN ssh.who ELSE 'root' END target,
  CASE ssh.how WHEN 'Failed' THEN 'ssh_login_failed' WHEN 'Accepted' THEN 'ssh_login_success' ELSE 'sudo_command' END action, ssh.port port, sudo.command command
FROM (SELECT line, regexp_extract(line, 'sshd\[\d+\]: (Failed|Accepted) \S+ for (?:invalid user )?(\S+) from (\S+)(?: port (\d+))?', ['how', 'who', 'ip', 'port']) ssh,
  regexp_extract(line, 'sudo(?:\[\d+\])?: +(\S+) : .*COMMAND=(.*)$', ['who', 'command']) sudo FROM ({AUTH_LINES}))
WHERE ssh.how <> '' OR sudo.who <> ''"""

MAC_LINES = f"""
SELECT concat(strftime(t, '%Y-%m-%d %H:%M:%S'), CASE WHEN seq % 2 = 0 THEN 'Z' ELSE '-0300' END,
  CASE kind WHEN 0 THEN concat(' authd: authentication FAILED for user ', u, ' from ', ip) WHEN 1 THEN concat(' authd: Authenticated user ', u) WHEN 2 THEN concat(' sudo[3]: ', u, ' : TTY=x ; USER=root ; COMMAND=/bin/ls ')
    WHEN 3 THEN ' launchd: bootout /Library/LaunchDaemons/a.plist' ELSE ' nothing' END) line
FROM ({duck("auth_lines")})"""

#: at, category, severity, actor, target and action of unified-log lines.
MAC = rf"""
SELECT CAST(epoch(strptime(substr(line, 1, 19), '%Y-%m-%d %H:%M:%S')) AS BIGINT) - CASE z.sign WHEN '' THEN 0 ELSE CAST(concat(z.sign, '1') AS BIGINT) * (3600 * CAST(z.h AS BIGINT) + 60 * CAST(z.m AS BIGINT)) END AS at,
  CASE WHEN sudo.who <> '' THEN 'privilege_escalation' WHEN plist <> '' THEN 'system' ELSE 'authentication' END category, CASE WHEN failed.who <> '' THEN 'medium' WHEN good <> '' THEN 'info' ELSE 'high' END severity,
  CASE WHEN failed.ip <> '' THEN failed.ip WHEN sudo.who <> '' THEN sudo.who ELSE '-' END actor, CASE WHEN failed.who <> '' THEN failed.who WHEN good <> '' THEN good WHEN sudo.who <> '' THEN sudo.run_as ELSE plist END target,
  CASE WHEN failed.who <> '' THEN 'macos_authentication_failure' WHEN good <> '' THEN 'macos_authentication_success' WHEN sudo.who <> '' THEN 'macos_sudo_execution' ELSE 'macos_launchd_persistence_unloaded' END action
FROM (SELECT line, regexp_extract(substr(line, 20), '^([+-])(\d\d)(\d\d)', ['sign', 'h', 'm']) z, regexp_extract(line, '(?i)authentication failed for user (\S+)(?: from (\S+))?', ['who', 'ip']) failed,
  regexp_extract(line, '(?i)authenticated user (\S+)', 1) good, regexp_extract(line, 'sudo\[\d+\]: (\S+) : .*USER=(\S+) ; COMMAND=', ['who', 'run_as']) sudo, regexp_extract(line, '(?i)(?:bootout|unloaded)\s*:?\s*(/\S+\.plist)', 1) plist FROM ({MAC_LINES}))
WHERE failed.who <> '' OR good <> '' OR sudo.who <> '' OR plist <> ''"""

#: subject, pid, comm, accessible, span, perms, path and base (name of the file) of each line of maps.
MAPS = rf"""
SELECT subject, pid, comm, accessible, m.span span, m.perms perms, trim(m.path) path, regexp_extract(regexp_replace(trim(m.path), ' \(deleted\)$', ''), '[^/]*$') base
FROM (SELECT *, regexp_extract(line, '^(\S+)\s+(\S+)\s+\S+\s+\S+\s+\S+\s*(.*)$', ['span', 'perms', 'path']) m FROM (SELECT *, unnest(maps) line FROM ({duck("memory")})))"""

#: The maps that can be executed, of snapshots that could be read, with the bits a letter of the file's name.
EXECUTABLE = f"""
SELECT * FROM (SELECT * FROM ({MAPS}) WHERE accessible AND contains(perms, 'x')) LEFT JOIN
(SELECT base, -sum(c / n * log2(c / n)) bits FROM (SELECT base, ch, count(*) c, max(length(base)) n FROM (SELECT base, unnest(string_split(base, '')) ch FROM (SELECT DISTINCT base FROM ({MAPS}) WHERE base <> '')) GROUP BY 1, 2) GROUP BY 1) USING (base)"""
STAGED = "(" + " OR ".join(f"starts_with(path, '{d}')" for d in T.STAGING_DIRS) + ")"


def scan(text: str) -> str:
    """The checks that a script's text fires, by comma. RE2's word boundary knows ASCII only: what may stand beside a word is named."""
    end, begin = r"(?:$|[^\p{L}\p{N}_])", r"(?:^|[^\p{L}\p{N}_])"
    m = lambda pattern: f"regexp_matches({text}, '{pattern}')"
    joins = " + ".join(rf"len(regexp_extract_all({text}, '{quote}\s*\+\s*{quote}'))" for quote in ('"', "''"))
    when = {
        "PSA-001": m(f"(?i)-EncodedCommand|-enc{end}|-e{end}"),
        "PSA-002": m(r"(?i)System\.Management\.Automation\.AmsiUtils|amsiContext|AmsiScanBuffer") + " OR " + m("(?is)bypass.*amsi|amsi.*bypass"),
        "PSA-003": m(f"(?i){begin}(?:IEX|Invoke-Expression){end}") + " AND " + m(r"(?i)Net\.WebClient|WebRequest|DownloadString|DownloadFile|curl|wget"),
        "PSA-004": m(r"(?i)-ExecutionPolicy\s+Bypass|-ep\s+Bypass|Set-ExecutionPolicy\s+(?:Bypass|Unrestricted)"),
        "PSA-005": m(f"(?i){begin}(?:certutil|mshta|rundll32|regsvr32|wscript|cscript|msiexec|installutil){end}"),
        "PSA-006": m("`[A-Za-z]") + " OR " + m(r"(?i)\[char\[\]\]") + f" OR {joins} >= 3",
        "PSA-007": m(rf"(?i)Mimikatz|mimi{end}|sekurlsa|kerberos::|PowerView|Invoke-BloodHound|SharpHound|Empire|Cobalt\s*Strike"),
    }
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {w} THEN '{check}' END" for check, w in when.items()) + ")"


SCRIPTS = f"""
SELECT artifact_id, checks, CAST(least(100, {" + ".join(f"CASE WHEN contains(checks, '{c}') THEN {w} ELSE 0 END" for c, (_, w) in T.CHECKS.items() if c.startswith("PSA"))}) AS BIGINT) r
FROM (SELECT artifact_id, {scan("command")} checks FROM (SELECT artifact_id, coalesce(command_text, '') command FROM ({duck("scripts")})))"""
SCRIPT_RISK = f"SELECT artifact_id, checks, r risk_score, CASE {' '.join(f'WHEN r >= {least} THEN {name!r}' for least, name in T.THREAT_LEVELS)} END threat_level FROM ({SCRIPTS})"

#: container_id and j, the inspected container; JSON that cannot be read gives an empty one.
INSPECTED = f"SELECT container_id, json_extract(CASE WHEN json_valid(inspect_json) THEN inspect_json ELSE '[{{}}]' END, '$[0]') j FROM ({duck('containers')})"
CONTEXT = f"""
SELECT container_id, coalesce(CAST(j->>'$.HostConfig.Privileged' AS BOOLEAN), false) privileged, coalesce(array_to_string(CAST(j->'$.HostConfig.CapAdd' AS VARCHAR[]), ','), '') cap_add, coalesce(j->>'$.HostConfig.NetworkMode', '') network_mode,
  coalesce(j->>'$.Config.User', '') AS user, coalesce(j->>'$.Config.Image', '-') image, coalesce(CAST(j->>'$.State.Running' AS BOOLEAN), false) running FROM ({INSPECTED})"""
ENV = f"""
SELECT container_id, coalesce(array_to_string(list_transform(CAST(j->'$.Config.Env' AS VARCHAR[]), lambda e: CASE WHEN contains(e, '=') AND regexp_matches(split_part(e, '=', 1), '{T.SECRET_NAME}') THEN concat(split_part(e, '=', 1), '=****[MASKED]') ELSE e END), ';'), '') env
FROM ({INSPECTED})"""
MOUNTS = f"SELECT container_id, m->>'$.Source' source, m->>'$.Destination' destination, CAST(m->>'$.RW' AS BOOLEAN) rw FROM (SELECT container_id, unnest(json_extract(j, '$.Mounts[*]')) m FROM ({INSPECTED}))"
