"""Fixed values that results depend on: names, ports, weights, patterns and lookup tables, as plain data."""

SEVERITY_RANK = {"info": 0, "low": 1, "medium": 2, "high": 3, "critical": 4}
ECS_SEVERITY = {"info": 1, "low": 21, "medium": 47, "high": 73}
CEF_SEVERITY = {"info": 1, "low": 3, "medium": 6, "high": 8}
ECS_CATEGORY = {
    "authentication": ["authentication"],
    "network": ["network"],
    "process": ["process"],
    "filesystem": ["file"],
    "privilege_escalation": ["process"],
    "system": ["host"],
}

# explicit event types, then keywords in order of precedence
EXPLICIT_TYPES = {
    "auth_fail": ["auth_fail", "login_failed", "4625"],
    "auth_success": ["auth_success", "login_success", "authenticated", "4624"],
    "sudo": ["sudo", "4672"],
    "user_add": ["user_add", "4720"],
    "persistence": ["persistence", "4698"],
}
KEYWORD_TYPES = [
    ("auth_fail", ["failed password", "authentication failure", "invalid user", "auth_fail", "login_failed", "failed_login"]),
    ("auth_success", ["accepted password", "session opened", "login_success", "auth_success", "authenticated", "accepted publickey", "logon", "4624"]),
    ("sudo", ["sudo", "privilege", "su ", "4672", "elevated"]),
    ("user_add", ["new user", "useradd", "user created", "4720"]),
    ("persistence", ["cron", "crontab", "startup", "autorun", "at ", "scheduled", "registry run", "4698"]),
    ("net_scan", ["nmap", "masscan", "scan", "probe", "port sweep"]),
    ("exploit", ["exploit", "payload", "shell", "reverse", "meterpreter"]),
]
LOGIN_TYPES = ["auth_success", "login_success", "authenticated", "4624"]
LOGIN_KEYWORDS = ["accepted password", "session opened", "login_success", "auth_success"]

# Windows event id -> category, severity, action
WINDOWS_EVENTS = [
    ("4624", "authentication", "info", "windows_logon_success"),
    ("4625", "authentication", "medium", "windows_logon_failure"),
    ("4648", "authentication", "high", "windows_explicit_credential_logon"),
    ("4720", "system", "high", "windows_user_account_created"),
    ("4728", "privilege_escalation", "high", "windows_group_member_added_global"),
    ("4732", "privilege_escalation", "high", "windows_group_member_added_local"),
    ("4756", "privilege_escalation", "high", "windows_group_member_added_universal"),
    ("4776", "authentication", "medium", "windows_ntlm_auth_attempt"),
    ("7045", "system", "high", "windows_service_installed"),
]

# action -> technique id, name, tactic, confidence
TECHNIQUES = [
    ("account_enum", "T1087", "Account Discovery", "Discovery", "high"),
    ("auth_failure", "T1110", "Brute Force", "Credential Access", "high"),
    ("autorun_add", "T1547.001", "Registry Run Keys / Startup Folder", "Persistence", "high"),
    ("bash_exec", "T1059.004", "Unix Shell", "Execution", "high"),
    ("credential_dump", "T1003", "OS Credential Dumping", "Credential Access", "high"),
    ("cron_add", "T1053.003", "Cron", "Persistence", "high"),
    ("data_exfil", "T1041", "Exfiltration Over C2 Channel", "Exfiltration", "high"),
    ("dir_listing", "T1083", "File and Directory Discovery", "Discovery", "medium"),
    ("kerberos_failure", "T1558.003", "Kerberoasting", "Credential Access", "high"),
    ("large_upload", "T1048", "Exfiltration Over Alternative Protocol", "Exfiltration", "high"),
    ("lateral_move", "T1021", "Remote Services", "Lateral Movement", "high"),
    ("launch_agent_add", "T1543.001", "Launch Agent", "Persistence", "high"),
    ("launch_daemon_add", "T1543.004", "Launch Daemon", "Persistence", "high"),
    ("log_clear", "T1070.001", "Clear Windows Event Logs", "Defense Evasion", "high"),
    ("log_deleted", "T1070.002", "Clear Linux or Mac System Logs", "Defense Evasion", "high"),
    ("login_failure", "T1110", "Brute Force", "Credential Access", "high"),
    ("network_scan", "T1046", "Network Service Discovery", "Discovery", "high"),
    ("passwd_change", "T1098", "Account Manipulation", "Persistence", "high"),
    ("powershell_exec", "T1059.001", "PowerShell", "Execution", "high"),
    ("privilege_escalation", "T1068", "Exploitation for Privilege Escalation", "Privilege Escalation", "high"),
    ("process_start", "T1059", "Command and Scripting Interpreter", "Execution", "medium"),
    ("rdp_login", "T1021.001", "Remote Desktop Protocol", "Lateral Movement", "high"),
    ("script_exec", "T1059", "Command and Scripting Interpreter", "Execution", "high"),
    ("service_install", "T1543.003", "Windows Service", "Persistence", "high"),
    ("setuid_exec", "T1548.001", "Setuid and Setgid", "Privilege Escalation", "high"),
    ("smb_access", "T1021.002", "SMB/Windows Admin Shares", "Lateral Movement", "high"),
    ("ssh_auth_failure", "T1110.003", "Password Spraying", "Credential Access", "high"),
    ("ssh_key_add", "T1098.004", "SSH Authorized Keys", "Persistence", "high"),
    ("ssh_login", "T1021.004", "SSH", "Lateral Movement", "medium"),
    ("startup_add", "T1547.001", "Registry Run Keys / Startup Folder", "Persistence", "high"),
    ("sudo_exec", "T1548.003", "Sudo and Sudo Caching", "Privilege Escalation", "high"),
    ("suid_execution", "T1548.001", "Setuid and Setgid", "Privilege Escalation", "high"),
    ("timestamps_modified", "T1070.006", "Timestomp", "Defense Evasion", "high"),
]
# keyword in an action -> the same, in order of precedence
TECHNIQUE_KEYWORDS = [
    ("brute", "T1110", "Brute Force", "Credential Access", "medium"),
    ("spray", "T1110.003", "Password Spraying", "Credential Access", "medium"),
    ("dump", "T1003", "OS Credential Dumping", "Credential Access", "medium"),
    ("escalat", "T1068", "Exploitation for Privilege Escalation", "Privilege Escalation", "medium"),
    ("persist", "T1547", "Boot or Logon Autostart Execution", "Persistence", "medium"),
    ("lateral", "T1021", "Remote Services", "Lateral Movement", "medium"),
    ("exfil", "T1041", "Exfiltration Over C2 Channel", "Exfiltration", "medium"),
    ("scan", "T1046", "Network Service Discovery", "Discovery", "medium"),
    ("clearlog", "T1070", "Indicator Removal", "Defense Evasion", "medium"),
    ("mimikatz", "T1003", "OS Credential Dumping", "Credential Access", "high"),
    ("whoami", "T1033", "System Owner/User Discovery", "Discovery", "medium"),
    ("ifconfig", "T1016", "System Network Configuration Discovery", "Discovery", "medium"),
    ("passwd", "T1003.008", "/etc/passwd and /etc/shadow", "Credential Access", "medium"),
    ("shadow", "T1003.008", "/etc/passwd and /etc/shadow", "Credential Access", "medium"),
]

# processes
PARENT_CHILDREN = {
    "acrobat.exe": ["cmd.exe", "powershell.exe", "wscript.exe"],
    "acrord32.exe": ["cmd.exe", "powershell.exe", "wscript.exe"],
    "chrome.exe": ["cmd.exe", "powershell.exe"],
    "excel.exe": ["cmd.exe", "cscript.exe", "mshta.exe", "powershell.exe", "wscript.exe"],
    "iexplore.exe": ["cmd.exe", "mshta.exe", "powershell.exe", "wscript.exe"],
    "outlook.exe": ["cmd.exe", "mshta.exe", "powershell.exe", "wscript.exe"],
    "powerpnt.exe": ["cmd.exe", "powershell.exe", "wscript.exe"],
    "winrar.exe": ["cmd.exe", "powershell.exe"],
    "winword.exe": ["cmd.exe", "cscript.exe", "mshta.exe", "powershell.exe", "wscript.exe"],
}
SYSTEM_PROCESSES = ["csrss.exe", "lsass.exe", "services.exe", "smss.exe", "svchost.exe", "wininit.exe"]
LOLBINS = ["appsync.exe", "bitsadmin.exe", "certutil.exe", "cmstp.exe", "cscript.exe", "installutil.exe", "msbuild.exe", "mshta.exe", "msiexec.exe", "odbcconf.exe", "regasm.exe", "regsvcs.exe", "regsvr32.exe", "rundll32.exe", "wscript.exe"]
ATTACK_TOOLS = ["bloodhound", "cobalt", "covenant", "crackmapexec", "empire", "impacket", "kerbrute", "lazagne", "meterpreter", "mimikatz", "ncat", "netcat", "psexec", "pwdump", "rubeus", "sharphound", "socat", "wce.exe"]
WINDOWS_SHELLS = ["cmd.exe", "powershell.exe"]
SERVICE_PARENTS = ["lsass.exe", "services.exe", "svchost.exe"]

# network
SUSPICIOUS_PORTS = [1337, 4444, 5554, 6666, 7777, 8888, 9001, 9050, 31337]
MINING_PORTS = [3333, 4444, 5555, 7777, 14433, 14444, 45560, 45700]
TOR_PORTS = [9001, 9050]
ADMIN_PORTS = [139, 445, 3389, 5985, 5986]

# memory
STAGING_DIRS = ["/dev/mqueue/", "/dev/shm/", "/run/shm/", "/tmp/", "/var/tmp/"]
SERVER_PARENTS = ["apache2", "chrome", "chromium", "evince", "firefox", "httpd", "java", "libreoffice", "lighttpd", "mongod", "mysqld", "nginx", "node", "okular", "php", "php-fpm", "postgres", "python", "ruby", "soffice"]
UNIX_SHELLS = ["bash", "dash", "fish", "ksh", "nc", "ncat", "netcat", "perl", "python", "python3", "ruby", "sh", "tcsh", "zsh"]
MAP_LINE = r"^([0-9a-f]+-[0-9a-f]+)\s+([rwxps-]{4})\s+\S+\s+\S+\s+\S+\s*(.*)$"

# registry
WRITABLE_PATH = r"(?i)\\Temp\\|\\AppData\\|\\Public\\|\\Users\\|%temp%|%appdata%|%public%|\\Downloads\\|\\Desktop\\|\\Startup\\|C:\\Windows\\Temp\\"
WINLOGON_SAFE = {"userinit": "C:\\Windows\\system32\\userinit.exe,", "shell": "explorer.exe", "taskman": "", "appsetup": ""}

# scripts: patterns by check
SCRIPT_PATTERNS = {
    "PSA-001": r"(?i)-EncodedCommand|-enc\b|-e\b",
    "PSA-002": r"(?is)System\.Management\.Automation\.AmsiUtils|amsiContext|AmsiScanBuffer|Bypass(?=.*AMSI)|AMSI(?=.*Bypass)",
    "PSA-004": r"(?i)-ExecutionPolicy\s+Bypass|-ep\s+Bypass|Set-ExecutionPolicy\s+Bypass|Set-ExecutionPolicy\s+Unrestricted",
    "PSA-005": r"(?i)\b(?:certutil|mshta|rundll32|regsvr32|wscript|cscript|msiexec|installutil)\b",
    "PSA-007": r"(?i)Mimikatz|mimi\b|sekurlsa|kerberos::|Invoke-Mimikatz|PowerView|Invoke-BloodHound|SharpHound|Empire|Cobalt\s*Strike|CobaltStrike|cobaltstrike",
}
SCRIPT_RUNS = r"(?i)\b(?:IEX|Invoke-Expression)\b"
SCRIPT_LOADS = r"(?i)Net\.WebClient|WebRequest|DownloadString|DownloadFile|curl|wget"
SCRIPT_TICK, SCRIPT_CHARS, SCRIPT_JOIN_DOUBLE, SCRIPT_JOIN_SINGLE = r"`[A-Za-z]", r"(?i)\[char\[\]\]", '"\\s*\\+\\s*"', r"'\s*\+\s*'"
SCRIPT_TECHNIQUES = {"PSA-001": "Encoded Command Execution", "PSA-002": "AMSI Bypass", "PSA-003": "Download Cradle", "PSA-004": "Execution Policy Bypass", "PSA-005": "LOLBins Abuse", "PSA-006": "Script Obfuscation", "PSA-007": "Known Attack Framework"}
THREAT_LEVELS = [(70, "CRITICAL"), (40, "HIGH"), (20, "MEDIUM"), (0, "LOW")]

# check -> severity (None where it depends on the row), weight
CHECKS = {
    "PT-001": ("CRITICAL", 40), "PT-002": ("CRITICAL", 45), "PT-003": ("HIGH", 35), "PT-004": ("HIGH", 30), "PT-005": ("MEDIUM", 20), "PT-006": ("HIGH", 30), "PT-007": ("CRITICAL", 45),
    "NC-001": ("HIGH", 25), "NC-002": ("HIGH", 30), "NC-003": ("HIGH", 35), "NC-004": ("CRITICAL", 35), "NC-005": ("CRITICAL", 40), "NC-006": ("MEDIUM", 20), "NC-007": ("CRITICAL", 40),
    "PSA-001": ("CRITICAL", 45), "PSA-002": ("CRITICAL", 45), "PSA-003": ("HIGH", 30), "PSA-004": ("HIGH", 25), "PSA-005": ("HIGH", 25), "PSA-006": ("MEDIUM", 20), "PSA-007": ("CRITICAL", 45),
    "REG-P-001": (None, 25), "REG-P-002": (None, 20), "REG-P-003": ("MEDIUM", 15), "REG-P-004": (None, 30), "REG-P-005": ("CRITICAL", 40), "REG-P-006": ("HIGH", 35), "REG-P-007": ("CRITICAL", 40),
    "MA-001": ("CRITICAL", 35), "MA-002": ("HIGH", 25), "MA-003": ("HIGH", 25), "MA-004": ("HIGH", 20), "MA-005": ("MEDIUM", 15), "MA-006": ("HIGH", 25), "MA-007": ("MEDIUM", 10),
}

SECRET_NAME = r"(?i)key|token|secret|password|passwd|pwd|auth|credential|api_key|private|cert|seed"
