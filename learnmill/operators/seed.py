"""The curriculum's reference graph."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

GRAPH = "curriculum"
# Node id, label, domain, grade level, description.
NODES = (
    (1, "Cell", "Biology", 8, "The basic unit of life"),
    (2, "Nucleus", "Biology", 8, "Control center of the cell containing DNA"),
    (3, "Mitochondria", "Biology", 8, "Powerhouse of the cell, produces energy"),
    (4, "Chloroplast", "Biology", 8, "Organelle where photosynthesis occurs"),
    (5, "Cell Membrane", "Biology", 8, "Protective boundary controlling what enters/exits"),
    (6, "Cytoplasm", "Biology", 8, "Gel-like fluid inside the cell"),
    (7, "Photosynthesis", "Biology", 8, "Process plants use to make food from sunlight"),
    (8, "Sunlight", "Biology", 8, "Energy source for photosynthesis"),
    (9, "Oxygen", "Biology", 8, "Gas produced by photosynthesis"),
    (10, "Carbon Dioxide", "Biology", 8, "Gas used in photosynthesis"),
    (11, "Glucose", "Biology", 8, "Sugar produced during photosynthesis"),
    (12, "Water", "Biology", 8, "Essential for photosynthesis"),
    (20, "Ecosystem", "Biology", 8, "Community of living and non-living things"),
    (21, "Producer", "Biology", 8, "Organism that makes its own food"),
    (22, "Consumer", "Biology", 8, "Organism that eats other organisms"),
    (23, "Decomposer", "Biology", 8, "Organism that breaks down dead matter"),
    (24, "Food Chain", "Biology", 8, "Sequence of who eats whom"),
    (25, "Food Web", "Biology", 8, "Interconnected food chains"),
    (50, "Energy", "Physics", 8, "Ability to do work or cause change"),
    (51, "Kinetic Energy", "Physics", 8, "Energy of motion"),
    (52, "Potential Energy", "Physics", 8, "Stored energy"),
    (53, "Force", "Physics", 8, "Push or pull on an object"),
    (54, "Gravity", "Physics", 8, "Force that pulls objects toward each other"),
    (55, "Motion", "Physics", 8, "Change in position over time"),
    (56, "Speed", "Physics", 8, "How fast something moves"),
    (57, "Velocity", "Physics", 8, "Speed in a specific direction"),
    (58, "Acceleration", "Physics", 8, "Change in velocity over time"),
    (70, "Matter", "Chemistry", 8, "Anything that has mass and takes up space"),
    (71, "Atom", "Chemistry", 8, "Smallest unit of an element"),
    (72, "Element", "Chemistry", 8, "Pure substance made of only one type of atom"),
    (73, "Molecule", "Chemistry", 8, "Two or more atoms bonded together"),
    (74, "Compound", "Chemistry", 8, "Substance made of two or more elements"),
    (75, "Proton", "Chemistry", 8, "Positive particle in nucleus"),
    (76, "Neutron", "Chemistry", 8, "Neutral particle in nucleus"),
    (77, "Electron", "Chemistry", 8, "Negative particle orbiting nucleus"),
    (90, "Water Cycle", "Earth Science", 8, "Continuous movement of water on Earth"),
    (91, "Evaporation", "Earth Science", 8, "Water changing from liquid to gas"),
    (92, "Condensation", "Earth Science", 8, "Water changing from gas to liquid"),
    (93, "Precipitation", "Earth Science", 8, "Water falling from clouds"),
    (94, "Weather", "Earth Science", 8, "Condition of atmosphere at a place and time"),
    (95, "Climate", "Earth Science", 8, "Average weather over long period"),
    (96, "Plate Tectonics", "Earth Science", 8, "Theory of Earth moving plates"),
    (97, "Earthquake", "Earth Science", 8, "Shaking from plate movement"),
    (98, "Volcano", "Earth Science", 8, "Opening where lava erupts"),
)
# Edge id, start node, end node, type, context, importance.
EDGES = (
    (101, 1, 2, "CONTAINS", "Cell contains nucleus", None),
    (102, 1, 3, "CONTAINS", "Cell contains mitochondria", None),
    (103, 1, 4, "CONTAINS", "Plant cells contain chloroplasts", None),
    (104, 1, 5, "HAS", "Cell has a membrane", None),
    (105, 1, 6, "CONTAINS", "Cell contains cytoplasm", None),
    (106, 2, 3, "REGULATES", "Nucleus regulates mitochondria", None),
    (107, 3, 11, "PRODUCES", "Mitochondria produces energy from glucose", None),
    (201, 7, 8, "REQUIRES", "Photosynthesis needs sunlight", "high"),
    (202, 7, 10, "USES", "Uses carbon dioxide", "high"),
    (203, 7, 12, "USES", "Uses water", "high"),
    (204, 7, 9, "PRODUCES", "Produces oxygen", "high"),
    (205, 7, 11, "PRODUCES", "Produces glucose", "high"),
    (206, 4, 7, "SITE_OF", "Chloroplast is site of photosynthesis", None),
    (207, 11, 3, "FEEDS", "Glucose feeds mitochondria", None),
    (301, 20, 7, "INCLUDES", "Ecosystems include photosynthesis", None),
    (302, 20, 21, "INCLUDES", "Ecosystems have producers", None),
    (303, 20, 22, "INCLUDES", "Ecosystems have consumers", None),
    (304, 20, 23, "INCLUDES", "Ecosystems have decomposers", None),
    (305, 21, 7, "PERFORMS", "Producers perform photosynthesis", None),
    (306, 22, 21, "EATS", "Consumers eat producers", None),
    (307, 24, 21, "STARTS_WITH", "Food chains start with producers", None),
    (308, 25, 24, "INCLUDES", "Food webs include food chains", None),
    (501, 50, 51, "INCLUDES", "Energy includes kinetic energy", None),
    (502, 50, 52, "INCLUDES", "Energy includes potential energy", None),
    (503, 51, 55, "CAUSES", "Kinetic energy causes motion", None),
    (504, 52, 51, "BECOMES", "Potential energy becomes kinetic", None),
    (505, 53, 55, "CAUSES", "Force causes motion", None),
    (506, 54, 53, "IS_A", "Gravity is a force", None),
    (507, 53, 58, "CAUSES", "Force causes acceleration", None),
    (508, 55, 56, "HAS", "Motion has speed", None),
    (509, 55, 57, "HAS", "Motion can have velocity", None),
    (510, 57, 58, "CAN_HAVE", "Velocity can have acceleration", None),
    (601, 70, 71, "MADE_OF", "Matter is made of atoms", None),
    (602, 72, 71, "CONTAINS", "Elements contain atoms", None),
    (603, 73, 71, "MADE_OF", "Molecules are made of atoms", None),
    (604, 74, 72, "MADE_OF", "Compounds are made of elements", None),
    (605, 71, 75, "CONTAINS", "Atoms contain protons", None),
    (606, 71, 76, "CONTAINS", "Atoms contain neutrons", None),
    (607, 71, 77, "CONTAINS", "Atoms contain electrons", None),
    (608, 11, 73, "IS_A", "Glucose is a molecule", None),
    (609, 12, 73, "IS_A", "Water is a molecule", None),
    (701, 90, 91, "INCLUDES", "Water cycle includes evaporation", None),
    (702, 90, 92, "INCLUDES", "Water cycle includes condensation", None),
    (703, 90, 93, "INCLUDES", "Water cycle includes precipitation", None),
    (704, 94, 90, "AFFECTED_BY", "Weather affected by water cycle", None),
    (705, 95, 94, "RELATED_TO", "Climate related to weather", None),
    (706, 96, 97, "CAUSES", "Plate tectonics causes earthquakes", None),
    (707, 96, 98, "CAUSES", "Plate tectonics causes volcanoes", None),
    (708, 20, 90, "INCLUDES", "Ecosystem includes water cycle", None),
    (801, 1, 71, "MADE_OF", "Cells are made of atoms", None),
    (802, 7, 73, "PRODUCES", "Photosynthesis produces molecules", None),
    (901, 8, 50, "IS", "Sunlight is energy", None),
    (902, 7, 50, "TRANSFORMS", "Photosynthesis transforms energy", None),
    (903, 54, 12, "AFFECTS", "Gravity affects water", None),
    (1001, 53, 97, "CAUSES", "Forces cause earthquakes", None),
    (1002, 50, 91, "PROVIDES", "Energy provides for evaporation", None),
)


def seed_nodes(spark: SparkSession) -> DataFrame:
    rows = [(GRAPH, node, label, json.dumps({"domain": domain, "grade_level": grade, "description": text})) for node, label, domain, grade, text in NODES]
    return spark.createDataFrame(rows, "graph_name string, node_id long, label string, properties string")


def seed_edges(spark: SparkSession) -> DataFrame:
    rows = []
    for edge, start, end, label, context, importance in EDGES:
        properties = {"context": context} if importance is None else {"importance": importance, "context": context}
        rows.append((GRAPH, edge, start, end, label, json.dumps(properties)))
    return spark.createDataFrame(rows, "graph_name string, edge_id long, start_node_id long, end_node_id long, edge_label string, properties string")
