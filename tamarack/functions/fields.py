"""Names of fields: rules write CamelCase, events may have snake_case; both mean one field."""

from __future__ import annotations

import re

#: The fields of rules that have a snake_case name in events by rule (an underscore before each capital after the first).
CAMEL = """
CommandLine Image ParentImage ParentCommandLine OriginalFileName CurrentDirectory User LogonId IntegrityLevel Hashes ProcessId
ParentProcessId ProcessGuid ParentProcessGuid Company Product Description FileVersion UtcTime DestinationIp DestinationPort
DestinationHostname SourceIp SourcePort Protocol Initiated SourceIsIpv6 DestinationIsIpv6 TargetFilename CreationUtcTime TargetObject
EventType Details QueryName QueryStatus QueryResults PipeName EventNamespace Name Destination Consumer Filter ImageLoaded
SignatureStatus Signature Signed SourceImage TargetImage GrantedAccess CallTrace ClientInfo IsExecutable Archived TargetUserName
TargetDomainName SubjectUserName SubjectDomainName LogonType IpAddress IpPort WorkstationName AuthenticationPackageName Status SubStatus
FailureReason TargetLogonId SubjectLogonId PrivilegeList ServiceName ServiceFileName ServiceType ServiceStartType ObjectName ObjectType
AccessMask TaskName TaskContent ScriptBlockText ScriptBlockId Path HostApplication HostName ThreatName NewValue OldValue
""".split()
#: Fields that events name as rules do.
SAME = "comm exe key syscall uid gid euid pid ppid a0 a1 a2 a3 cwd proctitle md5 sha1 sha256 imphash".split()
#: Fixed value: the one field with another name.
OTHER = {"type": "audit_type"}


def snake(name: str) -> str:
    return re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name).lower()


class FieldMapping:
    """Names of rules to names of events, without regard to case."""

    def __init__(self, pairs: dict[str, str] | None = None):
        self._forward: dict[str, str] = {}
        self._reverse: dict[str, str] = {}
        self.add_mappings({c: snake(c) for c in CAMEL} | {s: s for s in SAME} | OTHER if pairs is None else pairs)

    @classmethod
    def empty(cls) -> FieldMapping:
        return cls({})

    def add_mapping(self, rule_name: str, event_name: str) -> None:
        """Of several event names of a rule's name the last counts, of several rule names of an event's name the first."""
        self._forward[rule_name.lower()] = event_name
        self._reverse.setdefault(event_name.lower(), rule_name.lower())

    def add_mappings(self, pairs: dict[str, str]) -> None:
        for rule_name, event_name in pairs.items():
            self.add_mapping(rule_name, event_name)

    def translate(self, rule_name: str) -> str:
        return self._forward.get(rule_name.lower(), rule_name)

    def keys_of(self, name: str) -> list[str]:
        """Lower-case keys under which an event may have the field that a rule names."""
        low = name.lower()
        event = self._forward.get(low, low).lower()
        return list(dict.fromkeys([low, event, self._reverse.get(low, low), self._reverse.get(event, event)]))

    def enrich(self, event: dict[str, str]) -> dict[str, str]:
        """The event with the rules' names, in lower case, beside its own where it does not have them."""
        more = {self._reverse[k.lower()]: v for k, v in event.items() if k.lower() in self._reverse and self._reverse[k.lower()] not in event}
        return event | more

    def __len__(self) -> int:
        return len(self._forward)
