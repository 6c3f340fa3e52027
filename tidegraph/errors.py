"""Errors with stable codes."""

from __future__ import annotations


class EngineError(Exception):
    code = "internal_error"

    def envelope(self) -> dict:
        return {"error": self.code, "message": str(self)}


class UnknownService(EngineError):
    code = "service_not_found"

    def __init__(self, service: str):
        super().__init__(f"unknown service: {service}")
        self.service = service

    def envelope(self) -> dict:
        return super().envelope() | {"service": self.service}


class InvalidRequest(EngineError):
    code = "invalid_request"


class PipelineClosed(EngineError):
    code = "service_unavailable"
