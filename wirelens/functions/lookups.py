"""Lookup tables."""

# Service names by port.
SERVICES = {
    20: "ftp-data", 21: "ftp", 22: "ssh", 23: "telnet", 25: "smtp", 37: "time", 43: "whois", 49: "tacacs", 53: "dns",
    67: "dhcp-server", 68: "dhcp-client", 69: "tftp", 79: "finger", 80: "http", 88: "kerberos", 110: "pop3", 111: "rpcbind",
    123: "ntp", 135: "msrpc", 137: "netbios-ns", 138: "netbios-dgm", 139: "netbios-ssn", 143: "imap", 161: "snmp",
    162: "snmptrap", 179: "bgp", 389: "ldap", 427: "svrloc", 443: "https", 445: "microsoft-ds", 465: "smtps", 500: "isakmp",
    512: "rexec", 513: "rlogin", 514: "syslog", 515: "printer", 548: "afp", 554: "rtsp", 587: "submission", 591: "http-alt",
    593: "http-rpc-epmap", 623: "ipmi", 636: "ldaps", 644: "sane", 771: "rtelnet", 873: "rsync", 902: "vmware-auth",
    993: "imaps", 995: "pop3s", 1080: "socks", 1099: "jmx", 1194: "openvpn", 1214: "kazaa", 1241: "nessus", 1293: "ipsec",
    1433: "mssql", 1521: "oracle", 1723: "pptp", 1812: "radius", 1900: "upnp", 2049: "nfs", 2082: "cpanel",
    2083: "cpanel-ssl", 2121: "ftp-proxy", 2181: "zookeeper", 2375: "docker", 2376: "docker-tls", 2404: "iec-104",
    2483: "oracle-tcp", 2484: "oracle-ssl", 3000: "node-dev", 3128: "squid", 3260: "iscsi", 3306: "mysql", 3389: "rdp",
    3478: "stun", 3690: "svn", 4321: "rwhois", 4444: "metasploit", 4500: "ipsec-nat", 4567: "sinema", 4840: "opc-ua",
    5000: "upnp-alt", 5001: "synology", 5060: "sip", 5222: "xmpp", 5353: "mdns", 5357: "wsd", 5432: "postgresql",
    5555: "adb", 5601: "kafka-manager", 5672: "amqp", 5666: "nrpe", 5800: "vnc-http", 5900: "vnc", 5938: "teamviewer",
    5984: "couchdb", 6000: "x11", 6001: "x11", 6379: "redis", 6443: "kubernetes-api", 6660: "irc-alt", 6667: "irc",
    7001: "weblogic", 7070: "http-alt", 8000: "http-alt", 8008: "http-alt", 8009: "ajp13", 8010: "xmpp",
    8080: "http-proxy", 8081: "http-alt", 8443: "https-alt", 8500: "consul", 8686: "jmx-alt", 8888: "http-alt",
    9000: "sonar", 9001: "tor-orport", 9080: "websphere", 9100: "printer-jetdirect", 9200: "elasticsearch", 9418: "git",
    9999: "abyss", 10000: "webmin", 11211: "memcached", 12345: "netbus", 27017: "mongodb", 31337: "elite",
    50050: "java-rmi", 55553: "metasploit-http", 61613: "smpp",
}

# Ports whose service is named for UDP alone.
UDP_ONLY = (53, 67, 68, 69, 123, 137, 138, 161, 500, 514, 1900, 5353, 3478)

# Ports of clear-text HTTP.
CLEARTEXT_HTTP_PORTS = (80, 591, 593, 7070, 8000, 8008, 8080, 8081, 8443, 8888, 9000, 9080, 9999, 10000)

# Application protocol by transport and port.
L7 = {
    ("udp", 53): "dns", ("tcp", 53): "dns", ("udp", 67): "dhcp", ("udp", 68): "dhcp", ("tcp", 80): "http",
    ("tcp", 8080): "http", ("tcp", 8000): "http", ("tcp", 443): "tls", ("tcp", 8443): "tls", ("tcp", 22): "ssh",
    ("tcp", 21): "ftp", ("tcp", 25): "smtp", ("tcp", 587): "smtp", ("tcp", 110): "pop3", ("tcp", 143): "imap",
    ("tcp", 23): "telnet", ("tcp", 445): "smb", ("tcp", 139): "smb", ("tcp", 88): "kerberos", ("tcp", 389): "ldap",
    ("tcp", 3389): "rdp", ("tcp", 3306): "mysql", ("tcp", 5432): "postgresql", ("tcp", 6379): "redis",
}

# Ports that offensive tools use by default.
ABUSED_PORTS = {
    4444: "Metasploit default handler", 5555: "ADB / reverse shell", 31337: "Elite / backdoor", 50050: "Metasploit RPC",
    4445: "Metasploit", 6666: "IRC-based C2", 6667: "IRC-based C2", 12345: "NetBus", 12346: "NetBus", 54321: "NetBus 2",
}

# Domain-controller and LDAP ports, and the first dynamic RPC port.
DC_PORTS = (88, 135, 389, 445, 464, 636, 3268, 3269)
LDAP_PORTS = (389, 636, 3268, 3269)
EPHEMERAL_MIN = 49152

# Vendors by the first three octets of a MAC address.
OUI = {
    "00:00:0c": "Cisco", "00:01:6c": "IBM", "00:0c:29": "VMware", "00:0d:3a": "Microsoft Azure", "00:11:32": "Synology",
    "00:15:5d": "Microsoft Hyper-V", "00:16:3e": "Xen", "00:1e:58": "D-Link", "00:22:19": "Dell", "00:24:e8": "Dell",
    "00:40:96": "Cisco", "00:50:56": "VMware", "00:a0:c9": "Intel", "00:e0:4c": "Realtek", "01:00:5e": "IPv4 multicast",
    "03:00:00": "Cisco PVST+", "08:00:07": "Apple", "08:00:27": "Oracle VirtualBox", "0c:c4:7a": "Cisco",
    "10:7b:44": "Cisco", "20:4c:9e": "TP-Link", "24:5a:4c": "Dell", "28:c2:dd": "Huawei", "30:b5:c2": "Dell",
    "3c:07:54": "Apple", "34:17:eb": "Dell EMC", "40:b0:fa": "H3C", "44:37:e6": "Huawei", "48:0f:cf": "H3C",
    "50:9a:4c": "H3C", "54:bf:64": "Huawei", "58:61:53": "D-Link", "58:d5:6e": "Dell", "5c:f9:dd": "Cisco",
    "60:6d:c7": "Cisco", "64:51:06": "Apple", "68:05:ca": "Cisco", "6c:3b:e5": "Cisco", "74:e1:b6": "Huawei",
    "80:c1:6e": "Huawei", "84:16:f9": "Huawei", "8c:ec:4b": "Huawei", "94:57:a5": "Dell", "98:4b:e1": "Cisco",
    "9c:b6:54": "Ubiquiti", "a4:2b:b0": "Microsoft", "a4:bb:6d": "H3C", "ac:de:48": "Apple", "b8:27:eb": "Raspberry Pi",
    "c8:3a:35": "D-Link", "cc:46:d6": "Cisco", "d4:6a:6a": "Dell", "d8:cb:8a": "Cisco", "dc:a6:32": "Raspberry Pi",
    "e4:5f:01": "Raspberry Pi", "f0:18:98": "Apple", "f0:9f:c2": "Apple", "f8:bc:12": "H3C", "fc:fb:fb": "Cisco",
}

# ATT&CK techniques, their tactic and name.
TECHNIQUES = {
    "T1046": ("Discovery", "Network Service Discovery"),
    "T1595": ("Reconnaissance", "Active Scanning"),
    "T1595.001": ("Reconnaissance", "Active Scanning: Scanning IP Blocks"),
    "T1071.001": ("Command and Control", "Application Layer Protocol: Web Protocols"),
    "T1071.004": ("Command and Control", "Application Layer Protocol: DNS"),
    "T1095": ("Command and Control", "Non-Application Layer Protocol"),
    "T1132.001": ("Command and Control", "Data Encoding: Standard Encoding"),
    "T1571": ("Command and Control", "Non-Standard Port"),
    "T1573": ("Command and Control", "Encrypted Channel"),
    "T1105": ("Command and Control", "Ingress Tool Transfer"),
    "T1041": ("Exfiltration", "Exfiltration Over C2 Channel"),
    "T1048.003": ("Exfiltration", "Exfiltration Over Unencrypted Non-C2 Protocol"),
    "T1059": ("Execution", "Command and Scripting Interpreter"),
    "T1059.004": ("Execution", "Command and Scripting Interpreter: Unix Shell"),
    "T1083": ("Discovery", "File and Directory Discovery"),
    "T1190": ("Initial Access", "Exploit Public-Facing Application"),
    "T1505.003": ("Persistence", "Server Software Component: Web Shell"),
    "T1110": ("Credential Access", "Brute Force"),
    "T1552.001": ("Credential Access", "Unsecured Credentials: Credentials In Files"),
    "T1552.004": ("Credential Access", "Unsecured Credentials: Private Keys"),
    "T1557": ("Credential Access", "Adversary-in-the-Middle"),
}

# Domains of operating-system background traffic, matched with their subdomains.
TELEMETRY_DOMAINS = (
    "events.data.microsoft.com", "windowsupdate.com", "msftncsi.com", "windows.com", "bing.com", "msn.com", "apple.com", "in-addr.arpa",
)

# Two-label public suffixes.
TWO_PART_TLDS = (
    "co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "co.jp", "or.jp", "co.nz", "com.br", "com.cn", "co.in", "co.kr", "com.mx", "co.za", "com.tr",
)

# Severity weights, confidence multipliers.
SEVERITY_WEIGHT = {"INFO": 0, "LOW": 15, "MEDIUM": 35, "HIGH": 65, "CRITICAL": 90}
CONFIDENCE_FACTOR = {"high": 1.0, "medium": 0.7, "low": 0.4}

# File magic (bytes, offset, name), tried in this order.
MAGIC = [
    (b"MZ", 0, "Windows PE executable"), (b"\x7fELF", 0, "ELF executable"), (b"\xca\xfe\xba\xbe", 0, "Mach-O / Java class"),
    (b"PK\x03\x04", 0, "ZIP archive (or Office/JAR)"), (b"Rar!\x1a\x07", 0, "RAR archive"), (b"7z\xbc\xaf\x27\x1c", 0, "7-Zip archive"),
    (b"\x1f\x8b", 0, "gzip archive"), (b"BZh", 0, "bzip2 archive"), (b"\xfd7zXZ\x00", 0, "XZ archive"), (b"%PDF", 0, "PDF document"),
    (b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", 0, "MS Office (OLE2) document"), (b"SQLite format 3\x00", 0, "SQLite database"),
    (b"\x89PNG\r\n\x1a\n", 0, "PNG image"), (b"GIF87a", 0, "GIF image"), (b"GIF89a", 0, "GIF image"), (b"\xff\xd8\xff", 0, "JPEG image"),
    (b"BM", 0, "BMP image"), (b"RIFF", 0, "RIFF container (WAV/AVI/WebP)"), (b"ID3", 0, "MP3 audio"), (b"ftyp", 4, "MP4/MOV video"),
    (b"\xff\xfb", 0, "MPEG audio"), (b"\xd4\xc3\xb2\xa1", 0, "pcap capture"), (b"\x0a\x0d\x0d\x0a", 0, "pcapng capture"),
    (b"-----BEGIN CERTIFICATE-----", 0, "PEM certificate"), (b"-----BEGIN ", 0, "PEM armored data"), (b"<?xml", 0, "XML document"),
    (b"<!DOCTYPE html", 0, "HTML document"), (b"<!doctype html", 0, "HTML document"), (b"<html", 0, "HTML document"),
    (b"#!", 0, "script with shebang"), (b"\x00\x00\x00\x1c\x66\x74\x79\x70", 4, "MPEG-4 video"),
]

# DNS record types and response codes.
QTYPES = {
    1: "A", 2: "NS", 5: "CNAME", 6: "SOA", 12: "PTR", 15: "MX", 16: "TXT", 17: "RP", 24: "SIG", 25: "KEY", 28: "AAAA", 29: "LOC",
    33: "SRV", 35: "NAPTR", 39: "DNAME", 41: "OPT", 43: "DS", 46: "RRSIG", 47: "NSEC", 48: "DNSKEY", 49: "DHCID", 50: "NSEC3",
    51: "NSEC3PARAM", 52: "TLSA", 59: "CDS", 60: "CDNSKEY", 61: "OPENPGPKEY", 62: "CSYNC", 63: "ZONEMD", 64: "SVCB", 65: "HTTPS",
    99: "SPF", 249: "TKEY", 250: "TSIG", 251: "IXFR", 252: "AXFR", 255: "ANY", 256: "URI", 257: "CAA",
}
RCODES = {0: "NOERROR", 1: "FORMERR", 2: "SERVFAIL", 3: "NXDOMAIN", 4: "NOTIMP", 5: "REFUSED"}

# Capture magic -> (format, byte order, timestamp units a second), and link types.
CAPTURE_MAGIC = {
    b"\xd4\xc3\xb2\xa1": ("pcap", "<", 1_000_000), b"\xa1\xb2\xc3\xd4": ("pcap", ">", 1_000_000),
    b"\x4d\x3c\xb2\xa1": ("pcap", "<", 1_000_000_000), b"\xa1\xb2\x3c\x4d": ("pcap", ">", 1_000_000_000),
}
LINKTYPES = {
    0: "NULL/loopback", 1: "Ethernet", 6: "Token ring", 8: "SLIP", 9: "PPP", 12: "Raw IP (BSD)", 101: "Raw IP", 105: "IEEE 802.11",
    107: "FDDI", 113: "Linux cooked (SLL)", 114: "Linux cooked v2 (SLL2)", 143: "DOCSIS", 195: "IEEE 802.15.4",
}
