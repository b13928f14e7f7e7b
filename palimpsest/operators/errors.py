"""What an operator refuses with."""


class VersionedError(Exception):
    """Base of the refusals below."""


class NotFound(VersionedError):
    pass


class AlreadyExists(VersionedError):
    pass


class NotADirectory(VersionedError):
    pass


class NotEmpty(VersionedError):
    pass


class Busy(VersionedError):
    pass


class Invalid(VersionedError):
    pass


class Exhausted(VersionedError):
    pass


class Corrupt(VersionedError):
    pass
