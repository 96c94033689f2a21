import pytest

from tessera.plans.steps import UnsupportedTraversal
from tessera.sources.fixtures import shape


@pytest.mark.parametrize(
    "text",
    [
        "g.withStrategies(ProductiveByStrategy).V().order().by('age')",
        "g.V(1).shortestPath().with('~tinkerpop.shortestPath.includeEdges')",
        "g.V(1).shortestPath().with('~tinkerpop.shortestPath.includeEdges', true)",
    ],
)
def test_what_is_not_built_is_refused(spark, text):
    with pytest.raises(UnsupportedTraversal, match="ProductiveBy|includeEdges"):
        shape(spark, [(1, 2)]).traverse(text).rows()
