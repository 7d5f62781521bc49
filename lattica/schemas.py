"""Schemas of the graph store and of graph blocks, and its static dimensions."""

from __future__ import annotations

CONCEPTS = "id long, uri string, surface_text string, anchor_token string, domain int, category int, subcategory int, specificity int, definition string, vector array<float>"
RELATIONS = "id long, source_id long, target_id long, relation_type_id int, weight double"
EDA = "struct<domain:int,category:int,subcategory:int,specificity:int,identity:string,modifier_1:string,modifier_2:string,confidence:double>"
RA = "struct<rel_type_id:int,rel_label:string,subject_ref:int,object_ref:int,weight:double,temporal:int,negated:boolean>"
MESSAGES = "array<struct<role:string,content:string>>"
EDA_WIDTH, RA_WIDTH = 8, 6

# Relation type ids, labels and inverse labels of the graph format.
RELATION_TYPES = (
    (1, "IsA", "HasInstance"),
    (2, "PartOf", "HasPart"),
    (3, "HasA", "PartOf"),
    (4, "HasProperty", "PropertyOf"),
    (5, "CapableOf", "CapabilityOf"),
    (6, "AtLocation", "LocationOf"),
    (7, "Causes", "CausedBy"),
    (8, "HasPrerequisite", "PrerequisiteOf"),
    (9, "HasFirstSubevent", "FirstSubeventOf"),
    (10, "HasLastSubevent", "LastSubeventOf"),
    (11, "MotivatedByGoal", "GoalOf"),
    (12, "UsedFor", "UsedBy"),
    (13, "CreatedBy", "Creates"),
    (14, "DefinedAs", "Defines"),
    (15, "SymbolOf", "SymbolizedBy"),
    (16, "MadeOf", "MaterialOf"),
    (17, "ReceivesAction", "ActionAppliedTo"),
    (18, "Desires", "DesiredBy"),
    (19, "CausesDesire", "DesireCausedBy"),
    (20, "HasContext", "ContextOf"),
    (21, "SimilarTo", "SimilarTo"),
    (22, "Antonym", "Antonym"),
    (23, "DerivedFrom", "DerivesInto"),
    (24, "RelatedTo", "RelatedTo"),
    (25, "FormOf", "HasForm"),
    (26, "EtymologicallyRelatedTo", "EtymologicallyRelatedTo"),
    (27, "Synonym", "Synonym"),
    (28, "MannerOf", "HasManner"),
    (29, "LocatedNear", "LocatedNear"),
    (30, "HasContext", "ContextOf"),
    (31, "dbpedia/genre", ""),
    (32, "dbpedia/occupation", ""),
    (33, "dbpedia/language", ""),
    (34, "dbpedia/capital", ""),
)
LABEL_OF = {i: label for i, label, _ in RELATION_TYPES}
#: A label shared by two ids parses to the larger one.
ID_OF = {label: i for i, label, _ in RELATION_TYPES}
#: The importer reads relations by uri; id 30 has no uri of its own.
URI_TO_ID = {f"/r/{label}": i for i, label, _ in RELATION_TYPES if i != 30}
