"""Errors. Messages name the operation, the step and, where one is known, the image."""


class RasterError(Exception):
    """Any error of this library."""


class PipelineError(RasterError):
    """A pipeline that can't be parsed or doesn't fit its input. `kind` names the reason."""

    def __init__(self, kind: str, message: str, step: int | None = None):
        super().__init__(f"step {step}: {message}" if step is not None else message)
        self.kind, self.step = kind, step

    def at(self, step: int) -> "PipelineError":
        return PipelineError(self.kind, str(self), step)


class CodecError(RasterError):
    """Bytes that can't be decoded, or a format that can't be written."""


class SessionError(RasterError):
    """An unknown handle, or an operation that its images don't allow."""
