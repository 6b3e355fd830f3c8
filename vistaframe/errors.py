"""What can be wrong with a request."""


class EngineError(Exception):
    pass


class JsonRequestError(EngineError):
    """The request isn't well-formed."""


class QueryParsingError(EngineError):
    """The request is well-formed but doesn't fit the schema."""


class FieldNotFound(QueryParsingError):
    def __init__(self, name: str) -> None:
        super().__init__(f"field {name} is not found")


class UnknownDataset(EngineError):
    def __init__(self, name: str) -> None:
        super().__init__(f"dataset {name} does not exist")


class RegistryError(EngineError):
    pass
