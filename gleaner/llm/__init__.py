"""Operators for preparing training text: packing, decontamination, quality,
substring and near-duplicate removal, personal data, search, extraction,
sharding and licences.

Nothing else in the library imports this subpackage.
"""
