"""Line rules as data: categories, severities, patterns and what to do about them."""

from __future__ import annotations

# category: (severity, column the pattern is tested on, pattern)
REQUEST_RULES = {
    "sql_injection": (
        "HIGH", "decoded_path",
        r"(?i)'\s*(or|and)\b|\bunion\s+(all\s+)?select\b|\binformation_schema\b|;\s*drop\s+table\b|\bsleep\s*\(",
    ),
    "xss": ("HIGH", "decoded_path", r"(?i)<\s*script|javascript:|\bon(error|load)\s*="),
    "path_traversal": ("HIGH", "decoded_path", r"(?i)\.\./|\.\.\\|/etc/(passwd|shadow)|/proc/self/|boot\.ini"),
    "command_injection": (
        "HIGH", "decoded_path",
        r"(?i)([;|`]|&&|\$\()\s*(cat|ls|id|wget|curl|nc|bash|sh|whoami|powershell)\b|\$\{jndi:",
    ),
    "suspicious_agent": (
        "MEDIUM", "user_agent",
        r"(?i)sqlmap|nikto|nmap|masscan|zgrab|dirbuster|gobuster|wpscan|hydra|metasploit|nessus|acunetix",
    ),
    "c2_path": ("HIGH", "decoded_path", r"(?i)^/(gate\.php|submit\.php\?id=|jquery-3\.3\.1\.slim\.min\.js|__utm\.gif)"),
}

# Each text pattern comes with plain pieces, one of which any match contains: lines without them are not searched.
FAILED_LOGIN = (
    r"(?i)failed (password|publickey|login|none)|authentication failure|failed to log on|login failed", ["fail"])
LOGIN = (
    r"(?i)accepted (password|publickey|keyboard)|logged on successfully|login succeeded",
    ["accepted ", "logged on", "login succeeded"])
LOGIN_USER = r"(?:for|user[ =:]) ?(?:invalid user |user )?'?([\w.\\$@-]+)"
SUDO_COMMAND = r"^\s*(\S+) : .*COMMAND="
SUDO_FAILURE = r"authentication failure;.*logname=(\S*)"
GROUP_GRANT = (r"(?i)add(?:ed)? '?([\w.-]+)'? to (?:shadow )?group '?(?:sudo|wheel|admin|root|docker)", ["group "])
NEW_USER = (r"(?i)new user: name=([^,\s]+)", ["new user: name="])
UID_ZERO = r"\bUID=0\b"
CHANGED_USER = (r"(?i)change user '([^']+)'", ["change user '"])
MODE_CHANGE = (r"(?i)\bchmod\b.*\b[0-7]?777\b|\bchmod\b.*\bu\+s\b", ["chmod"])

WINDOWS_ACCOUNT = (
    r"(?is)(?:user account was (?:created|changed|enabled|deleted)|attempt was made to (?:change|reset) an account|member was added to a security-enabled)"
    r".*?(?:new account|target account|member):.*?name:\s*([\w.$@\\=-]+)", ["account was ", "member was added", "an account"])
LOG_RESTART = (r"(?i)audit log was cleared|event logging service (?:has shut down|was (?:started|stopped))|rsyslogd.*\b(?:start|exiting)",
               ["log was cleared", "logging service", "rsyslogd"])
PORT = (r"\b(?:DPT|dst_port|dport)=(\d{1,5})\b", ["dpt=", "dst_port=", "dport="])

# Extra fields, in order, that hold what formats without a column for it tell of a request or a connection.
PATH_FIELDS = ["path", "request_path", "uri", "request_uri", "url", "request"]
AGENT_FIELDS = ["user_agent", "userAgent", "http_user_agent", "agent"]
STATUS_FIELDS = ["status_code", "statusCode", "http_status", "response_code"]
BYTES_FIELDS = ["bytes_sent", "bytes", "body_bytes_sent", "bytes_out", "response_size"]
PORT_FIELDS = ["dst_port", "dest_port", "destination_port", "dpt"]

# Categories whose findings are single moments, so that their last second tells them apart.
MOMENTS = ["success_after_failures"]

# category: (title, recommendation, remediation action, command, undo command); {s} is the subject
RESPONSES = {
    "brute_force": (
        "Brute force from {s}", "Block the source at the firewall and review the targeted accounts.",
        "block_ip", "iptables -I INPUT -s {s} -j DROP", "iptables -D INPUT -s {s} -j DROP"),
    "credential_stuffing": (
        "Credential stuffing from {s}", "Block the source and require a second factor.",
        "block_ip", "iptables -I INPUT -s {s} -j DROP", "iptables -D INPUT -s {s} -j DROP"),
    "success_after_failures": (
        "Login after failures from {s}", "End the session and rotate the credentials used.",
        "kill_session", "ss -K src {s}", ""),
    "sql_injection": (
        "SQL injection attempts from {s}", "Block the source and check the queries behind the requested paths.",
        "block_ip", "iptables -I INPUT -s {s} -j DROP", "iptables -D INPUT -s {s} -j DROP"),
    "xss": (
        "Script injection attempts from {s}", "Encode output on the requested pages.",
        "block_ip", "iptables -I INPUT -s {s} -j DROP", "iptables -D INPUT -s {s} -j DROP"),
    "path_traversal": (
        "Path traversal attempts from {s}", "Check that file access is confined to the document root.",
        "block_ip", "iptables -I INPUT -s {s} -j DROP", "iptables -D INPUT -s {s} -j DROP"),
    "command_injection": (
        "Command injection attempts from {s}", "Isolate the host if any request succeeded.",
        "block_ip", "iptables -I INPUT -s {s} -j DROP", "iptables -D INPUT -s {s} -j DROP"),
    "suspicious_agent": (
        "Scanner user agent from {s}", "Rate-limit or block the source.",
        "block_ip", "iptables -I INPUT -s {s} -j DROP", "iptables -D INPUT -s {s} -j DROP"),
    "c2_path": (
        "Known command-and-control path from {s}", "Isolate the host and inspect it for malware.",
        "block_ip", "iptables -I INPUT -s {s} -j DROP", "iptables -D INPUT -s {s} -j DROP"),
    "privilege_escalation": (
        "Privilege escalation by {s}", "Confirm the commands with the account owner.",
        "disable_account", "usermod -L {s}", "usermod -U {s}"),
    "lateral_movement": (
        "New internal connection from {s}", "Confirm the connection with the system owner.", "none", "", ""),
    "scan": (
        "Scan from {s}", "Block the source.",
        "block_ip", "iptables -I INPUT -s {s} -j DROP", "iptables -D INPUT -s {s} -j DROP"),
    "beacon": (
        "Regular beacon from {s}", "Inspect the host for malware and capture its traffic.", "none", "", ""),
    "periodic_contact": (
        "Contact at a fixed period from {s}", "Inspect the host for malware and capture its traffic.", "none", "", ""),
    "unusual_transfer": (
        "Unusual outbound transfer to {s}", "Compare with what is usually sent there.", "none", "", ""),
    "exfiltration": (
        "Large outbound transfer to {s}", "Check what was sent and whether it was meant to be.",
        "block_ip", "iptables -I OUTPUT -d {s} -j DROP", "iptables -D OUTPUT -d {s} -j DROP"),
    "account_change": (
        "Account change for {s}", "Confirm the change; lock the account if nobody asked for it.",
        "disable_account", "usermod -L {s}", "usermod -U {s}"),
    "log_restart": (
        "Log cleared or restarted on {s}", "Confirm with the system owner.", "none", "", ""),
    "failed_login": (
        "Failed logins from {s}", "Watch the source.", "none", "", ""),
}
