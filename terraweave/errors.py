"""Errors of guards, raised on the driver before a plan runs, and the exit codes they map to."""

from __future__ import annotations


class StudyError(Exception):
    exit_code = 3


class ConfigError(StudyError):
    exit_code = 2


class OptionalDependencyError(StudyError):
    exit_code = 4


class NetworkAccessError(StudyError):
    exit_code = 5


class IngestError(StudyError):
    pass


class CRSError(StudyError):
    pass


class CRSMismatchError(CRSError):
    pass


class UnknownCRSError(CRSError):
    pass


class GeographicCRSError(CRSError):
    pass


class NonMetreCRSError(CRSError):
    pass


class UnitError(StudyError):
    pass


class UnitMismatchError(UnitError):
    pass


class UnknownUnitError(UnitError):
    pass


class RasterError(StudyError):
    pass


class RasterGeometryError(RasterError):
    pass


class RasterAlignmentError(RasterError):
    pass


class MissingDataError(StudyError):
    pass


class GraphError(StudyError):
    pass


class ProvenanceError(StudyError):
    pass


class PrivacyError(StudyError):
    pass


class ValidationFailedError(StudyError):
    exit_code = 1


class BundleError(StudyError):
    pass
