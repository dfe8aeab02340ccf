"""What can go wrong, each with a status and a code as a service would report them."""


class GraphloomError(Exception):
    status, code = 500, "INTERNAL_ERROR"


class BadRequest(GraphloomError, ValueError):
    status, code = 400, "BAD_REQUEST"


class ValidationFailed(GraphloomError, ValueError):
    status, code = 422, "VALIDATION_ERROR"


class NotFound(GraphloomError, LookupError):
    status, code = 404, "NOT_FOUND"


class ModelUnavailable(GraphloomError):
    status, code = 503, "MODEL_UNAVAILABLE"


class ModelFailed(GraphloomError):
    status, code = 502, "MODEL_ERROR"
