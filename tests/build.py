"""Rows and constants that several test modules share."""

from datetime import datetime, timedelta, timezone

SMALL = "/root/testdata/sf0.001"
START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def event(i, at_us, entity="ENT-1", **other):
    """One access event ``at_us`` microseconds after the start."""
    base = {
        "event_id": f"EVT-{i:09d}",
        "timestamp": START + timedelta(microseconds=at_us),
        "entity_id": entity,
        "entity_type": "user",
        "role": "developer",
        "source_ip": "10.0.0.1",
        "country": "Germany",
        "city": "Frankfurt",
        "latitude": 50.1109,
        "longitude": 8.6821,
        "auth_method": "SSO",
        "auth_success": True,
        "resource_accessed": "view/0",
        "action": "VIEW",
        "command_sequence": "VIEW",
        "session_duration_s": 10.0,
        "bytes_transferred": 1000.0,
        "device_id": "DEV-1",
        "device_os": "Linux",
        "device_firmware": "N/A",
        "device_protocol": "HTTPS",
        "device_mac": "mac-1",
        "label": "BENIGN",
        "is_attack": False,
        "campaign_id": None,
    }
    return base | other
