"""What to redact. A flag that is off keeps its branch out of the plan."""

from __future__ import annotations

from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Policy:
    name: bool = True
    email: bool = True
    phone: bool = True
    company: bool = True
    address: bool = True
    ssn: bool = True
    credit_card: bool = True
    dob: bool = True
    ip: bool = True
    pan: bool = True
    aadhaar: bool = True
    passport: bool = True
    faces: bool = True
    id_documents: bool = True
    signatures: bool = True
    qr: bool = True

    @classmethod
    def only(cls, *names: str) -> Policy:
        return cls(**{f.name: f.name in names for f in fields(cls)})
