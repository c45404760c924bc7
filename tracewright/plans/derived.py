"""Inputs of the operators, derived from the test tables by one text for Spark and DuckDB.

In the texts ``{t}`` is the table, ``DIV`` whole division, ``LIST(`` an array, ``US(`` a time in microseconds.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

EVENTS_K = "(SELECT *, CAST(regexp_extract(props, '[0-9]+', 0) AS INT) AS k FROM {t})"

VIEWS = {
    "corr_events": ("events", f"""
SELECT event_id AS seq, CAST(ts AS TIMESTAMP) AS ts, 'events' AS source,
  CASE event_type WHEN 'error' THEN 'auth_fail' WHEN 'signup' THEN 'auth_success' WHEN 'purchase' THEN 'sudo' WHEN 'click' THEN CASE WHEN k % 2 = 0 THEN 'net_scan' ELSE 'user_add' END ELSE CASE WHEN k % 2 = 0 THEN 'exploit' ELSE 'persistence' END END AS event_type,
  concat('10.0.', CAST(user_id DIV 250 AS STRING), '.', CAST(user_id % 250 AS STRING)) AS source_ip,
  concat('user', CAST(k % 20 AS STRING)) AS username, concat('host', CAST(event_id % 12 AS STRING)) AS hostname
FROM {EVENTS_K}"""),
    "timeline": ("events", f"""
SELECT event_id AS seq, concat('case', CAST(user_id % 10 AS STRING)) AS case_id, CAST(ts AS TIMESTAMP) AS ts, concat('log_', event_type) AS source, concat('host', CAST(event_id % 12 AS STRING)) AS host,
  CASE event_type WHEN 'error' THEN 'authentication' WHEN 'signup' THEN 'process' WHEN 'purchase' THEN 'network' WHEN 'click' THEN 'filesystem' ELSE 'system' END AS category,
  CASE WHEN value < 20 THEN 'info' WHEN value < 40 THEN 'low' WHEN value < 60 THEN 'medium' WHEN value < 80 THEN 'high' ELSE 'critical' END AS severity,
  CASE WHEN k % 3 = 0 THEN concat('10.0.0.', CAST(k % 200 AS STRING)) ELSE concat('user', CAST(k % 20 AS STRING)) END AS actor,
  concat('target', CAST(k % 7 AS STRING)) AS target,
  CASE k % 9 WHEN 0 THEN 'SSH_login' WHEN 1 THEN 'cron_add' WHEN 2 THEN 'port scan' WHEN 3 THEN 'read /etc/shadow' WHEN 4 THEN 'log_clear' WHEN 5 THEN 'opened' WHEN 6 THEN 'data_exfil' WHEN 7 THEN 'brute force of login' ELSE 'login_failure' END AS action,
  concat('=raw|', props) AS raw
FROM {EVENTS_K}"""),
    "auth_lines": ("events", f"""
SELECT event_id AS seq, CAST(ts AS TIMESTAMP) AS t, concat('host', CAST(event_id % 12 AS STRING)) AS h, concat('10.0.0.', CAST(user_id % 250 AS STRING)) AS ip, concat('user', CAST(k % 20 AS STRING)) AS u, k % 5 AS kind, k
FROM {EVENTS_K}"""),
    "processes": ("part", """
SELECT concat('host', CAST(p_partkey % 50 AS STRING)) AS subject, p_partkey AS pid, p_partkey DIV 3 AS ppid,
  CASE p_partkey % 13 WHEN 0 THEN 'cmd.exe' WHEN 1 THEN 'PowerShell.exe' WHEN 2 THEN 'svchost.exe' WHEN 3 THEN 'lsass.exe' WHEN 4 THEN 'certutil.exe' WHEN 5 THEN 'notepad.exe' WHEN 6 THEN 'Mimikatz.exe' WHEN 7 THEN 'winword.exe' WHEN 8 THEN 'explorer.exe' WHEN 9 THEN 'mshta.exe' WHEN 10 THEN 'csrss.exe' WHEN 11 THEN 'python.exe' ELSE 'services.exe' END AS name,
  CASE p_partkey % 7 WHEN 0 THEN 'WINWORD.EXE' WHEN 1 THEN 'chrome.exe' WHEN 2 THEN 'svchost.exe' WHEN 3 THEN 'explorer.exe' WHEN 4 THEN 'services.exe' WHEN 5 THEN 'outlook.exe' ELSE '' END AS parent_name,
  CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'cmd.exe' WHEN 2 THEN concat('run ', p_name) WHEN 3 THEN 'PsExec -s' ELSE 'powershell.exe ' END AS cmdline,
  CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN concat('C:', CHR(92), 'Windows', CHR(92), 'System32', CHR(92), 'x.exe') ELSE concat('C:', CHR(92), 'Temp', CHR(92), 'x.exe') END AS path,
  CAST(p_size AS INT) AS child_count
FROM {t}"""),
    "connections": ("lineitem", """
SELECT concat('host', CAST(l_suppkey % 20 AS STRING)) AS subject, l_suppkey AS pid, concat('proc', CAST(l_suppkey % 17 AS STRING)) AS process_name,
  CASE l_partkey % 6 WHEN 0 THEN '10.0.0.5' WHEN 1 THEN '172.16.3.4' WHEN 2 THEN '8.8.8.8' WHEN 3 THEN '[fd00::1]' WHEN 4 THEN '::ffff:192.168.1.25' ELSE '172.32.0.1' END AS remote_addr,
  CAST(CASE l_partkey % 11 WHEN 0 THEN 4444 WHEN 1 THEN 9001 WHEN 2 THEN 445 WHEN 3 THEN 3333 WHEN 4 THEN 3389 ELSE 443 END AS INT) AS remote_port,
  CAST(l_orderkey % 50 AS INT) AS local_port, CASE l_linestatus WHEN 'O' THEN 'ESTABLISHED' ELSE 'LISTEN' END AS state,
  CASE l_partkey % 5 WHEN 0 THEN concat(md5(CAST(l_orderkey AS STRING)), '.example.com') WHEN 1 THEN 'www.example.com' WHEN 2 THEN 'aaaaaaaaaaaaaaaaaaaaaaaaaaaa' ELSE NULL END AS hostname
FROM {t}"""),
    "scripts": ("part", """
SELECT CAST(p_partkey AS STRING) AS artifact_id,
  CASE p_partkey % 12 WHEN 0 THEN 'powershell -enc SQBFAFgA' WHEN 1 THEN '[Ref].Assembly AmsiScanBuffer' WHEN 2 THEN 'IEX (New-Object Net.WebClient).DownloadString(1)' WHEN 3 THEN 'powershell -ExecutionPolicy  Bypass x' WHEN 4 THEN 'certutil -urlcache'
   WHEN 5 THEN 'i`e`x' WHEN 6 THEN 'Invoke-Mimikatz -e x' WHEN 7 THEN concat('"a"+"b" + "c"', '+"d"') WHEN 8 THEN p_name WHEN 9 THEN 'try Bypass of the AMSI' WHEN 10 THEN 'wget http://x' ELSE NULL END AS command_text
FROM {t}"""),
    "registry": ("part", """
SELECT concat('host', CAST(p_partkey % 50 AS STRING)) AS subject,
  CASE p_partkey % 7 WHEN 0 THEN 'run_keys' WHEN 1 THEN 'run_services' WHEN 2 THEN 'startup_files' WHEN 3 THEN 'services' WHEN 4 THEN 'ifeo_entries' WHEN 5 THEN 'appinit_dlls' ELSE 'winlogon_entries' END AS kind,
  'HKLM' AS hive, concat('n', CAST(p_partkey % 9 AS STRING)) AS name,
  CASE p_partkey % 4 WHEN 0 THEN concat('C:', CHR(92), 'Users', CHR(92), 'a', CHR(92), 'x.exe') WHEN 1 THEN 'explorer.exe' WHEN 2 THEN '' ELSE 'C:/Program Files/y.exe' END AS value,
  concat('f', CAST(p_partkey AS STRING), '.lnk') AS path,
  CASE p_partkey % 3 WHEN 0 THEN concat('%TEMP%', CHR(92), 's.exe') ELSE 'svc.exe' END AS image_path, 'i.exe' AS image, CASE p_partkey % 5 WHEN 0 THEN '' ELSE 'd.exe' END AS debugger,
  CASE p_partkey % 3 WHEN 0 THEN 'Shell' WHEN 1 THEN 'Taskman' ELSE 'Other' END AS key
FROM {t}"""),
    "memory": ("part", """
SELECT concat('host', CAST(p_partkey % 50 AS STRING)) AS subject, p_partkey AS pid, p_partkey DIV 3 AS ppid,
  CASE p_partkey % 5 WHEN 0 THEN 'bash' WHEN 1 THEN 'nginx' WHEN 2 THEN 'sshd' WHEN 3 THEN 'python3' ELSE 'java' END AS comm,
  CASE p_partkey % 4 WHEN 0 THEN '/usr/bin/bash' WHEN 1 THEN '/tmp/evil (deleted)' WHEN 2 THEN '' ELSE '/usr/sbin/nginx' END AS exe,
  CASE p_partkey % 3 WHEN 0 THEN 'nginx' WHEN 1 THEN 'systemd' ELSE 'Java' END AS parent_comm,
  LIST(CASE p_partkey % 3 WHEN 0 THEN '7f00-7f01 r-xp 00000000 fd:01 12    /usr/lib/libc.so.6' WHEN 1 THEN '7f00-7f01 rwxp 00000000 00:00 0' ELSE '7f00-7f01 r-xp 00000000 fd:01 12 /dev/shm/q8Zx7Kp2Vw9Lm (deleted)' END, '7f02-7f03 rw-p 00000000 fd:01 12 /tmp/data') AS maps,
  p_partkey % 10 <> 0 AS accessible
FROM {t}"""),
    "containers": ("supplier", """
SELECT CAST(s_suppkey AS STRING) AS container_id, CASE WHEN s_suppkey % 10 = 0 THEN 'not json' ELSE concat('[{{"Name": "/', s_name, '", "Config": {{"Image": "img', CAST(s_nationkey AS STRING), '", "User": "u", "Env": ["API_KEY=secret', CAST(s_suppkey AS STRING), '", "PATH=/usr/bin", "NO_EQUALS"]}}, "State": {{"Running": ', CASE WHEN s_suppkey % 2 = 0 THEN 'true' ELSE 'false' END, '}}, "HostConfig": {{"Privileged": ', CASE WHEN s_suppkey % 3 = 0 THEN 'true' ELSE 'false' END, ', "CapAdd": ["NET_ADMIN"], "NetworkMode": "host"}}, "Mounts": [{{"Type": "bind", "Source": "/s', CAST(s_suppkey % 4 AS STRING), '", "Destination": "/d", "Mode": "rw", "RW": true}}]}}]') END AS inspect_json
FROM {t}"""),
    "artifacts": ("orders", """
SELECT o_orderkey AS seq, CAST(o_custkey AS STRING) AS container_id, concat('type', CAST(o_orderkey % 3 AS STRING)) AS artifact_type, concat('c', CAST(o_orderkey AS STRING)) AS content, CAST(floor(o_totalprice) AS BIGINT) AS size_bytes, CASE WHEN o_orderkey % 7 = 0 THEN 'timeout' WHEN o_orderkey % 7 = 1 THEN '' ELSE NULL END AS error
FROM {t}"""),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The derived table as a DataFrame."""
    table, text = VIEWS[name]
    text = re.sub(r"\bDIV\b", "div", text).replace("LIST(", "array(").replace("CHR(", "chr(")
    return spark.sql(text, t=spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def duck(name: str) -> str:
    """The derived table as a DuckDB subquery."""
    table, text = VIEWS[name]
    text = text.replace("{t}", table).replace("{{", "{").replace("}}", "}")
    return re.sub(r"\bDIV\b", "//", text).replace("LIST(", "list_value(").replace("CHR(", "chr(")
