"""What the engine raises."""


class KeystrandError(Exception):
    """Any error of the engine."""


class KeyspaceDeleted(KeystrandError):
    """The keyspace was dropped."""


class Locked(KeystrandError):
    """Another writer holds the database."""


class Conflict(KeystrandError):
    """A later commit wrote what the transaction read."""


class InvalidVersion(KeystrandError):
    """The files have a format that this version does not read."""


class Poisoned(KeystrandError):
    """A commit broke off halfway; the handle takes no more writes."""
